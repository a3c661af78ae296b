"""Problem 6: rows of new batches that are already known.

The history is a pivot table: rows of a hash, holding its distances to fixed
pivots and its arranged suffixes, to which each batch only appends. The table is
range-partitioned by suffix; a pair of hashes at most 12 bits apart begins alike
in one of 19 arrangements (has distance 0 in that sub-space), so equal
beginnings in a range are joined, the triangle inequality over 16 pivot
distances prunes, and the true distance decides. Checksums, ids and addresses
are looked up by their canonical form.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulate.functions import normalise
from granulate.llm import bits
from granulate.llm.crosssplit import RADIUS, shared_spans, suffixes
from granulate.session import cut, shared_folder

BEFORE_ALL, AFTER_ALL = -(2**31), 2**31 - 1


def order(batch: Column, record: Column) -> Column:
    """Place of a row in time; rows without a batch number come last."""
    return F.struct(F.coalesce(batch.cast("int"), F.lit(AFTER_ALL)).alias("b"), record.cast("long").alias("r"))


def accepted(images: DataFrame) -> DataFrame:
    """Accepted images as history: before every batch."""
    rows = images.where(normalise.ident(F.col("curation_status")) == "accepted")
    return _fields(rows, order(F.lit(BEFORE_ALL), F.col("row_no")), F.lit(None).cast("long"))


def incoming(batches: DataFrame) -> DataFrame:
    """Rows of batches with their place in time."""
    return _fields(batches, order(F.col("batch_no"), F.col("record_no")), F.col("record_no"))


def _fields(df: DataFrame, ord_: Column, record: Column) -> DataFrame:
    digest = normalise.sha256_digest(F.col("file_sha256"))
    named = lambda tag, c: F.when(c.isNotNull(), F.unhex(F.md5(F.concat(F.lit(tag), c))))
    return df.select(
        ord_.alias("ord"),
        record.alias("record_no"),
        named("d", digest).alias("kd"),
        named("i", normalise.ident(F.col("image_id"))).alias("ki"),
        named("u", normalise.url_resource(F.col("source_url"))).alias("ku"),
        normalise.hex64(F.col("ahash")).alias("hash"),
    )


def exact_keys(rows: DataFrame) -> DataFrame:
    """One row per key of a row: k, ord, record_no."""
    return rows.select("ord", "record_no", F.explode(F.array_compact(F.array("kd", "ki", "ku"))).alias("k"))


def first_seen(rows: DataFrame) -> DataFrame:
    """k and the first place in time it occurs; combined before the shuffle."""
    return exact_keys(rows).groupBy("k").agg(F.min("ord").alias("lo"))


def hash_rows(rows: DataFrame) -> DataFrame:
    """hash with the first place of any row and the last place of an incoming row."""
    return rows.where("hash is not null").groupBy("hash").agg(
        F.min("ord").alias("lo"), F.max(F.when(F.col("record_no").isNotNull(), F.col("ord"))).alias("hi")
    )


def slot(key: Column) -> Column:
    """Key range of an arranged suffix: its arrangement and the two leading bits of its first block."""
    n = bits.arrangement(key)
    widths = F.array(*[F.lit(bits.EDGES[a + 1] - bits.EDGES[a] + bits.EDGES[b + 1] - bits.EDGES[b]) for a, b in bits.ARRANGEMENTS])
    return (n * 4 + F.call_function("shiftrightunsigned", key, F.get(widths, n) - 2).bitwiseAND(3)).cast("int")


def key_slot(k: Column) -> Column:
    """Range of an exact key: its first byte in steps of 16."""
    return F.shiftright(F.conv(F.hex(F.substring(k, 1, 1)), 16, 10).cast("int"), 4)


def hash_slot(h: Column) -> Column:
    """Range of a hash: its first digit."""
    return F.conv(F.substring(h, 1, 1), 16, 10).cast("int")


class History:
    """The accepted history on disk, to which batches are appended; no batch rereads raw history.

    `path` lies in shared storage. keys/ holds (k, lo), pivots/ the arranged
    suffixes of every hash with its distances to the pivots (key, piv, hid),
    hashes/ (hash, lo). Each is one folder a batch and key range (slot), sorted
    by key, so a batch reads only the ranges its own keys lie in.
    """

    TABLES = {
        "keys": ("slot int, k binary, lo struct<b:int,r:bigint>", lambda: key_slot(F.col("k")), "k"),
        "hashes": ("slot int, hash string, lo struct<b:int,r:bigint>", lambda: hash_slot(F.col("hash")), "hash"),
        "pivots": ("slot int, key bigint, piv bigint, hid bigint", lambda: slot(F.col("key")), "key"),
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, table: str, rows: DataFrame, name: str) -> None:
        _, at, by = self.TABLES[table]
        # One file a range and batch; adaptive execution cuts the ranges of a large batch into several.
        rows.withColumn("slot", at()).hint("rebalance", "slot").sortWithinPartitions("slot", by).write.mode("overwrite").partitionBy("slot").parquet(
            f"{self.path}/{table}/batch={name}"
        )

    def append(self, rows: DataFrame, name: str) -> None:
        """Write the rows' keys, pivot rows and hashes under `name`; repeating a name replaces it."""
        hashes = cut(hash_rows(rows).select("hash", "lo", bits.words(F.col("hash")).alias("w")))
        self._write("keys", first_seen(rows), name)
        self._write("hashes", hashes.select("hash", "lo"), name)
        self._write("pivots", suffixes(hashes.select("hash", "w")).drop("next"), name)

    def stored(self, table: str, mine: DataFrame | None = None) -> DataFrame:
        """A table of the history, of the ranges that the rows `mine` lie in (at most 76 range numbers are listed)."""
        schema, at, _ = self.TABLES[table]
        try:
            df = self.spark.read.schema("batch string, " + schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], "batch string, " + schema)  # nothing was appended yet
        if mine is not None:
            df = df.where(F.col("slot").isin([r[0] for r in mine.select(at().alias("slot")).distinct().collect()]))
        return df.drop("batch", "slot")

    def known(self, batch: DataFrame, radius: int = RADIUS) -> DataFrame:
        """record_no and ways (exact, hash) of rows of `batch` known from the history or from earlier rows of the batch.

        A NULL, blank or placeholder field matches nothing. An empty history or
        batch gives what the other leaves to match.
        """
        if radius > RADIUS:
            raise ValueError("20 blocks guarantee a shared span up to a radius of 12")
        mine_keys, mine = cut(exact_keys(batch)), cut(hash_rows(batch).withColumn("w", bits.words(F.col("hash"))))
        seen = mine_keys.groupBy("k").agg(F.min("ord").alias("lo"))
        first = (
            self.stored("keys", seen).join(seen.select("k"), "k", "left_semi").unionByName(seen)
            .groupBy("k").agg(F.min("lo").alias("lo"))
        )
        by_key = mine_keys.join(first, "k").where("lo < ord").select("record_no", F.lit("exact").alias("way"))
        # Bit 1: may be what a row of the batch is known by; bit 2: is in the batch.
        own = suffixes(mine.select("hash", "w")).drop("next")
        rows = self.stored("pivots", own).withColumn("side", F.lit(1)).unionByName(own.withColumn("side", F.lit(3))).withColumn("next", F.lit(0).cast("long"))
        old = self.stored("hashes")
        words = old.select("hash").unionByName(mine.select("hash")).distinct().select(F.xxhash64("hash").alias("hid"), bits.words(F.col("hash")).alias("w"))
        close = shared_spans(rows, words, radius).select(F.col("hb").alias("mine"), F.col("ha").alias("other"))
        # Only hashes that are near one of the batch, or equal to one, are looked up again.
        close = cut(close)
        wanted = close.select(F.col("other").alias("hid")).unionByName(mine.select(F.xxhash64("hash").alias("hid"))).distinct()
        every = (
            old.withColumn("hid", F.xxhash64("hash")).join(wanted, "hid", "left_semi").select("hash", "lo")
            .unionByName(mine.select("hash", "lo")).groupBy("hash").agg(F.min("lo").alias("lo"))
        )
        near = (
            close.join(mine.select(F.xxhash64("hash").alias("mine"), "hash", "hi"), "mine")
            .join(every.select(F.xxhash64("hash").alias("other"), F.col("hash").alias("text"), "lo"), "other")
            .where((F.col("lo") < F.col("hi")) & (bits.distance(bits.words(F.col("hash")), bits.words(F.col("text"))) <= radius))
            .select("hash", "lo")
        )
        same = every.join(mine.select("hash"), "hash", "left_semi").select("hash", "lo")
        first_hash = near.unionByName(same).groupBy("hash").agg(F.min("lo").alias("first"))
        by_hash = batch.where("hash is not null").join(first_hash, "hash").where("first < ord").select("record_no", F.lit("hash").alias("way"))
        return by_key.unionByName(by_hash).groupBy("record_no").agg(F.array_sort(F.collect_set("way")).alias("ways"))


def known(history: DataFrame, batches: DataFrame) -> DataFrame:
    """record_no and ways of known incoming rows: `history` is appended to a new store, `batches` are held against it as one delivery."""
    spark = batches.sparkSession
    store = History(spark, shared_folder(spark, "history"))
    store.append(history, "accepted")
    return store.known(cut(batches))


def found(images: DataFrame, batches: DataFrame) -> DataFrame:
    """record_no of every incoming row that is already known."""
    return known(cut(accepted(images)), incoming(batches)).select("record_no")
