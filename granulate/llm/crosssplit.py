"""Problem 2: records of evaluation splits that occur again in the training split.

A record's hash is a text of 256 bits. In each of 19 arrangements of its blocks
(see `bits`) it is one suffix; the suffixes are bucketed by their first 25 bits,
sorted inside the bucket and compared with the neighbour before them: the common
prefix is measured, and a run of neighbours that holds both sides of the split
is a set of shared spans. The spans of a pair are merged over all arrangements,
and the exact distance decides. A digest is one suffix whose common prefix must
be the whole text. Tiles are cut from one figure, so there the shared span is
the path up to the panel, and coverage is the shared part of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions import normalise
from granulate.llm import bits
from granulate.session import cut

RADIUS = 12
CELL = 1024
RUN = 4096  # pairs in a run from which it is cut finer before any pair is made
TILE_NAME = r"^(.+?)(?:[ _-]panel[ _-]([a-z0-9]+))?[ _-]tile((?:[ _-][xy]\d+)+).*$"


def image_rows(images: DataFrame) -> DataFrame:
    """row_no, train, digest and hash of every row that has a split."""
    return images.select(
        "row_no",
        normalise.split_name(F.col("split")).alias("split"),
        F.unhex(normalise.sha256_digest(F.col("file_sha256"))).alias("digest"),
        normalise.hex64(F.col("ahash")).alias("hash"),
    ).where("split is not null").select("row_no", (F.col("split") == "train").alias("train"), "digest", "hash")


def suffixes(hashes: DataFrame) -> DataFrame:
    """Arranged suffixes, 19 a hash: key (arrangement and first bits), next (the bits after), pivot row and hash id.

    The words of the hash are taken from `w` if there is such a column (they are
    named many times, so they should be kept, not worked out anew each time).
    """
    w = hashes if "w" in hashes.columns else hashes.withColumn("w", bits.words(F.col("hash")))
    return w.select(
        F.inline(bits.arranged(F.col("w"))),
        bits.pivot_distances(F.col("w")).alias("piv"),
        F.xxhash64("hash").alias("hid"),
        *[c for c in hashes.columns if c not in ("hash", "w")],
    )


def runs(sorted_: DataFrame) -> DataFrame:
    """Suffixes in runs that hold both sides, with the number of pairs of the run.

    `sorted_` holds key, next, hid, side (bit 1: left, bit 2: right) and more. Suffixes
    are sorted inside the bucket of their key and each is compared with the one before it.
    """
    w = Window.partitionBy("key")
    joint = F.lag("side").over(w.orderBy("next", "hid")).bitwiseOR(F.col("side"))
    # A run holds both sides if two neighbours in it do together.
    return (
        sorted_.select("*", joint.alias("joint")).select(
            "*", F.max("joint").over(w).alias("sides"),
            (F.sum(F.col("side").bitwiseAND(1)).over(w) * F.sum(F.shiftright("side", 1).bitwiseAND(1)).over(w)).alias("pairs"),
        )
        .where("sides = 3").drop("sides", "joint")
    )


def shared_spans(suffix_rows: DataFrame, words: DataFrame, radius: int) -> DataFrame:
    """ha, hb, prefix (bits of the longest common prefix), spans (blocks of the merged spans): pairs of a left and a right hash in one run whose pivots allow `radius`.

    `words` holds hid and w (the words of the hash). A run of many pairs, such as that of pictures with the same
    plain parts, is cut finer twice by 13 more blocks, of which a near pair
    shares one; so no pair is lost, and only pairs that agree in four blocks are
    compared there.
    """
    found = cut(runs(suffix_rows).select("key", "next", "piv", "hid", "side", "pairs", bits.mask(F.col("key")).alias("seen")))
    crowded = found.where(F.col("pairs") > RUN)
    parts = [found.where(F.col("pairs") <= RUN).select("key", "next", "piv", "hid", "side", "seen")]
    if not crowded.isEmpty():
        rows = crowded.join(words, "hid")
        for _ in range(2):
            rows = rows.select("hid", "w", "next", "piv", "side", "seen", F.explode(bits.finer(F.col("key"), F.col("w"), F.col("seen"))).alias("f")).select(
                "hid", "w", "next", "piv", "side", F.col("seen").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("f.b"))).alias("seen"), F.col("f.key").alias("key")
            )
        parts.append(rows.select("key", "next", "piv", "hid", "side", "seen"))
    out = None
    for p in parts:
        a = p.where("side & 1 != 0").select("key", "seen", F.col("next").alias("na"), F.col("piv").alias("pa"), F.col("hid").alias("ha"))
        b = p.where("side & 2 != 0").select("key", F.col("next").alias("nb"), F.col("piv").alias("pb"), F.col("hid").alias("hb"))
        pairs = a.join(b, "key").where((F.col("ha") != F.col("hb")) & (bits.pivot_bound(F.col("pa"), F.col("pb")) <= radius)).select("ha", "hb", "seen", F.col("na").bitwiseXOR(F.col("nb")).alias("ext"))
        out = pairs if out is None else out.unionByName(pairs)
    prefix = 25 + F.when(F.col("ext") == 0, bits.NEXT).otherwise(bits.NEXT - F.length(F.bin("ext")))
    return out.groupBy("ha", "hb").agg(F.max(prefix).alias("prefix"), F.bit_count(F.bit_or("seen")).alias("spans"))


def near_hashes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(train_hash, eval_hash, prefix, spans, bits) for different hashes at most `radius` <= 12 bits apart.

    Exact copies are folded first, so a group of copies costs one suffix set.
    """
    if radius > RADIUS:
        raise ValueError("20 blocks guarantee a shared span up to a radius of 12")
    hashes = cut(rows.where("hash is not null").groupBy("hash").agg(F.bit_or(F.when(F.col("train"), 1).otherwise(2)).alias("side")).withColumn("w", bits.words(F.col("hash"))))
    words = hashes.select(F.xxhash64("hash").alias("hid"), "w")
    close = shared_spans(suffixes(hashes), words, radius)
    texts = hashes.select(F.xxhash64("hash").alias("hid"), "hash")
    return (
        close.join(texts.select(F.col("hid").alias("ha"), F.col("hash").alias("train_hash")), "ha")
        .join(texts.select(F.col("hid").alias("hb"), F.col("hash").alias("eval_hash")), "hb")
        .select(
            "train_hash", "eval_hash", "prefix", "spans",
            bits.distance(bits.words(F.col("train_hash")), bits.words(F.col("eval_hash"))).alias("bits"),
        )
        .where((F.col("bits") <= radius) & (F.col("train_hash") != F.col("eval_hash")))
    )


def image_overlaps(images: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(train_key, eval_key, coverage): pairs of rows with one digest or near hashes.

    Rows without a split, digest or hash (NULL, blank, placeholder) are in no
    pair by that field. Repeated rows each count. An empty table gives no rows.
    """
    rows = cut(image_rows(images))  # thin, and read five times below
    t, e = rows.where("train"), rows.where("not train")
    same_digest = (
        t.where("digest is not null").select("digest", F.col("row_no").alias("train_key"))
        .join(e.where("digest is not null").select("digest", F.col("row_no").alias("eval_key")), "digest")
        .select("train_key", "eval_key", F.lit(1.0).alias("coverage"))
    )
    th = t.where("hash is not null").select(F.col("hash").alias("train_hash"), F.col("row_no").alias("train_key"))
    eh = e.where("hash is not null").select(F.col("hash").alias("eval_hash"), F.col("row_no").alias("eval_key"))
    same_hash = th.join(eh, th.train_hash == eh.eval_hash).select("train_key", "eval_key", F.lit(1.0).alias("coverage"))
    near = (
        near_hashes(rows, radius)
        .join(th, "train_hash")
        .join(eh, "eval_hash")
        .select("train_key", "eval_key", (1 - F.col("bits") / 256).alias("coverage"))
    )
    return (
        same_digest.unionByName(same_hash).unionByName(near)
        .groupBy("train_key", "eval_key").agg(F.max("coverage").alias("coverage"))
    )


def tile_windows(triage: DataFrame) -> DataFrame:
    """tile_no, train, figure, panel and the window y, x, h, w of every tile that has a split."""
    parsed = F.split(
        F.regexp_replace(F.lower(F.regexp_extract(F.col("tile_path"), r"([^/\\]*)$", 1)), TILE_NAME, "$1|$2|$3"), r"\|"
    )
    number = lambda c: F.col(c).try_cast("double").cast("long")
    place = lambda p, axis: F.regexp_extract(F.get(p, F.lit(2)), rf"[ _-]{axis}(\d{{1,15}})", 1).try_cast("long")
    window = normalise.let(
        parsed,
        lambda p: F.when(
            F.size(p) == 3,
            F.struct(F.get(p, F.lit(0)).alias("figure"), F.get(p, F.lit(1)).alias("panel"), place(p, "y").alias("y"), place(p, "x").alias("x")),
        ),
    )
    return triage.select(
        "tile_no",
        (normalise.split_name(F.col("split")) == "train").alias("train"),
        window.alias("at"),
        number("height").alias("h"),
        number("width").alias("w"),
    ).select("tile_no", "train", "at.*", "h", "w").where(
        "train is not null and figure is not null and y is not null and x is not null and h > 0 and w > 0"
    )


def tile_overlaps(triage: DataFrame, share: float = 0.5, cell: int = CELL) -> DataFrame:
    """(train_key, eval_key, coverage): tiles of one figure and panel sharing `share` of the smaller window.

    Windows are spread over grid cells, so that a figure with very many tiles is
    joined cell by cell; a pair counts in the cell that holds the upper left
    corner of the common part only.
    """
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(n) - 1) / cell)))
    t = tile_windows(triage).select("*", span("y", "h").alias("cy")).select("*", span("x", "w").alias("cx"))
    key = ["figure", "panel", "cy", "cx"]
    a = t.where("train").drop("train")
    b = t.where("not train").select(*key, *[F.col(c).alias(c + "2") for c in ("tile_no", "y", "x", "h", "w")])
    top, left = F.greatest("y", "y2"), F.greatest("x", "x2")
    dy = F.least(F.col("y") + F.col("h"), F.col("y2") + F.col("h2")) - top
    dx = F.least(F.col("x") + F.col("w"), F.col("x2") + F.col("w2")) - left
    smaller = F.least(F.col("h") * F.col("w"), F.col("h2") * F.col("w2"))
    return (
        a.join(b, key)
        .where((dy > 0) & (dx > 0) & (F.floor(top / cell) == F.col("cy")) & (F.floor(left / cell) == F.col("cx")))
        .where(dy * dx >= share * smaller)
        .select(F.col("tile_no").alias("train_key"), F.col("tile_no2").alias("eval_key"), (dy * dx / smaller).alias("coverage"))
    )


def overlaps(images: DataFrame, triage: DataFrame) -> DataFrame:
    """All cross-split pairs: kind, train_key, eval_key, coverage."""
    return (
        image_overlaps(images).withColumn("kind", F.lit("image"))
        .unionByName(tile_overlaps(triage).withColumn("kind", F.lit("tile")))
    )


def found(images: DataFrame, triage: DataFrame) -> DataFrame:
    """kind, key_a < key_b."""
    return overlaps(images, triage).select(
        "kind", F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")
    )


def counts(images: DataFrame, triage: DataFrame) -> DataFrame:
    """Pairs and leaked records per kind, evaluation split and source of the evaluation record."""
    i = images.select(F.lit("image").alias("kind"), F.col("row_no").alias("eval_key"), normalise.split_name(F.col("split")).alias("split"), normalise.ident(F.col("source_id")).alias("source"))
    t = triage.select(F.lit("tile").alias("kind"), F.col("tile_no").alias("eval_key"), normalise.split_name(F.col("split")).alias("split"), normalise.ident(F.col("source_pdf")).alias("source"))
    per = overlaps(images, triage).groupBy("kind", "eval_key").agg(F.count("*").alias("n"), F.max("coverage").alias("c"))
    return (
        per.join(i.unionByName(t), ["kind", "eval_key"])
        .groupBy("kind", "split", "source")
        .agg(F.sum("n").alias("pairs"), F.count("*").alias("records"), F.round(F.avg("c"), 6).alias("mean_coverage"))
    )
