"""Places in a global order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.session import cut


def placed(df: DataFrame, order: list[str], place: str = "place", total: str | None = None) -> DataFrame:
    """`df` with each row's place (from 0) in ascending order of `order`, which should name a unique key; ties get places in any order.

    Rows are partitioned by range and sorted within; a row's place is that in its
    range plus the rows of the ranges before, of which there is one number a partition.
    """
    # The borders of the ranges are sampled, so what they yield is kept before it is read twice.
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # over one row a partition
    offsets = sizes.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(place, at + F.col("_before"))
    return (out.withColumn(total, F.col("_total")) if total else out).drop("_id", "_part", "_before", "_total")


def every_nth(df: DataFrame, key: str, fraction: float = 0.15) -> DataFrame:
    """key, val: of the sorted keys every k-th validates until `fraction` of them (at least one) do; k is the whole part of keys per validating key."""
    p = placed(df.select(key).distinct(), [key], total="total")
    want = F.greatest(F.lit(1), F.bround(F.col("total") * fraction, 0)).cast("long")
    step = F.greatest(F.lit(1), F.floor(F.col("total") / want))
    return p.select(key, ((F.col("place") % step == 0) & (F.floor(F.col("place") / step) < want)).alias("val"))
