"""Content-addressed splits and leakage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions.text import stable_hash
from granulate.operators.ordering import placed

SPLITS = ("train", "val", "test")


def ranked(groups: DataFrame, key: str) -> DataFrame:
    """key, place (from 0) in the order of its SHA-1, and the number of keys, without sorting all keys in one task."""
    h = groups.select(key).distinct().withColumn("h", stable_hash(F.col(key)))
    return placed(h, ["h", key], total="total").select(key, "place", "total")


def split_of(place: Column, total: Column, train: float = 0.70, val: float = 0.15) -> Column:
    """Split of a group by its place: one group trains, the second of two validates, else by the cuts."""
    a = F.greatest(F.lit(1), F.bround(total * train, 0)).cast("long")
    b = F.greatest(a + 1, F.bround(total * (train + val), 0)).cast("long")
    return (
        F.when(total == 1, "train").when(total == 2, F.when(place == 0, "train").otherwise("val"))
        .when(place < a, "train").when(place < b, "val").otherwise("test")
    )


def assign(rows: DataFrame, group: str, train: float = 0.70, val: float = 0.15, keep: str | None = None) -> DataFrame:
    """rows with new_split; valid values of the column `keep` are kept. Rows without a group train."""
    r = ranked(rows.where(F.col(group).isNotNull()), group).select(group, split_of(F.col("place"), F.col("total"), train, val).alias("assigned"))
    out = rows.join(r, group, "left")
    new = F.coalesce("assigned", F.lit("train"))
    return out.withColumn("new_split", F.when(F.col(keep).isin(*SPLITS), F.col(keep)).otherwise(new) if keep else new).drop("assigned")


def running_val(rows: DataFrame, group: str, fraction: float = 0.15) -> DataFrame:
    """group, n, val: groups from the smallest (then by name) validate until `fraction` of the rows is reached."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    # Groups are counted by size first; only those of the size at which the target is reached are ordered by name.
    by_size = sizes.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy("n")  # distinct sizes: few, as k distinct ones need k * k / 2 rows
    upto, rows_ = F.sum(F.col("n") * F.col("k")).over(w), F.col("n") * F.col("k")
    at = by_size.select("n", (upto - rows_).alias("before"), upto.alias("upto"), F.sum(rows_).over(Window.partitionBy(F.lit(1))).alias("total"))
    at = at.withColumn("target", F.greatest(F.lit(1), F.bround(F.col("total") * fraction, 0)))
    # Groups that share the size at which the target falls; all below validate, none above (but the first of all always does).
    edge = (F.col("before") < F.col("target")) & (F.col("upto") > F.col("target"))
    j = sizes.join(at, "n")
    named = placed(j.where(edge), [group]).where(F.col("before") + F.col("n") * F.col("place") < F.col("target"))
    whole = j.where("upto <= target").select(group, F.lit(True).alias("val")).unionByName(named.select(group, F.lit(True).alias("val")))
    return sizes.join(whole, group, "left").select(group, "n", F.coalesce("val", F.lit(False)).alias("val"))


def torn_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split."""
    return (
        rows.where(F.coalesce(F.col(split), F.lit("")) != "").groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits"))
        .where(F.size("splits") > 1).select(group, F.array_join("splits", ",").alias("splits"))
    )


def duplicate_checksums(rows: DataFrame, checksum: str, split: str) -> DataFrame:
    """Checksums of two rows or more, with the splits they are in and whether that is a leak."""
    g = rows.where(F.coalesce(F.col(checksum), F.lit("")) != "").groupBy(checksum).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.coalesce(F.col(split), F.lit("")))).alias("s"))
    return g.where("n >= 2").select(checksum, "n", F.array_join("s", ",").alias("splits"), (F.size("s") > 1).alias("leak"))


def near_duplicates(rows: DataFrame, key: str, bits: str, radius: int = 3) -> DataFrame:
    """a < b, distance: pairs of 64-character bit texts at most `radius` apart, by radius + 1 equal bands.

    Equal texts are folded and joined once by their representative (least key),
    so copies cost no pairs: the result pairs representatives; see `classes`.
    """
    n = radius + 1
    reps = rows.where(F.length(bits) == 64).groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("k"))
    bounds = [64 * i // n for i in range(n + 1)]
    bands = F.array(*[F.concat(F.lit(f"{i}:"), F.substring("h", bounds[i] + 1, bounds[i + 1] - bounds[i])) for i in range(n)])
    word = lambda a: F.conv(F.substring("h", a, 32), 2, 10).cast("long")
    t = reps.select("k", word(1).alias("x"), word(33).alias("y"), F.explode(bands).alias("band"))
    b = t.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "band")
    d = F.bit_count(F.col("x").bitwiseXOR(F.col("x2"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("y2")))
    return t.join(b, "band").where("k < k2").select(F.col("k").alias("a"), F.col("k2").alias("b"), d.alias("distance")).where(F.col("distance") <= radius).distinct()


def classes(rows: DataFrame, key: str, bits: str) -> DataFrame:
    """key and the representative (least key) of its equal bit texts, for every row that `near_duplicates` reads."""
    whole = rows.where(F.length(bits) == 64)
    return whole.join(whole.groupBy(bits).agg(F.min(key).alias("representative")), bits).select(key, "representative")
