"""Particle tables derived from the driver's tables, alike in Spark and in the SQL twins.

The driver has no particle tables; lineitem serves as detections (V_det) and as
validation rows (V_val), events as measurements, embeddings as hash grids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.session import read


def det(spark, d) -> DataFrame:
    """image_id, seq, cx, cy, radius_px, class."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.row_number().over(w).alias("seq"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 512).cast("double").alias("cx"),
        ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 67) % 512).cast("double").alias("cy"),
        (F.col("l_quantity") * 4).alias("radius_px"), F.when(F.col("l_returnflag") == "R", "inner").otherwise("outer").alias("class"),
    )


DET = """det AS (
  SELECT l_orderkey AS image_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq,
         CAST((l_partkey * 37 + l_linenumber * 101) % 512 AS DOUBLE) AS cx, CAST((l_suppkey * 53 + l_linenumber * 67) % 512 AS DOUBLE) AS cy,
         l_quantity * 4 AS radius_px, CASE WHEN l_returnflag = 'R' THEN 'inner' ELSE 'outer' END AS class
  FROM lineitem)"""


def val(spark, d) -> DataFrame:
    """row, image_id, reference_diameter, measured_diameter, morphology, mode, status."""
    ref = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000)
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("particle_id"), F.col("l_partkey").alias("part"),
        ref.alias("reference_diameter"), F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / 1000 * (1 + F.col("l_discount") - 0.05)).alias("measured_diameter"),
        F.col("l_returnflag").alias("morphology"), F.col("l_linestatus").alias("mode"),
        F.when(F.col("l_quantity") == 50, "ambiguous").otherwise("").alias("status"),
    )


VAL = """val AS (
  SELECT l_orderkey AS image_id, l_linenumber AS particle_id, l_partkey AS part,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 1000 END AS ref,
         CASE WHEN l_tax <> 0 THEN l_extendedprice / 1000 * (1 + l_discount - 0.05) END AS mea,
         l_returnflag AS morphology, l_linestatus AS mode, CASE WHEN l_quantity = 50 THEN 'ambiguous' ELSE '' END AS status
  FROM lineitem),
cls AS (
  SELECT *, CASE WHEN ref IS NULL AND mea IS NULL THEN NULL WHEN ref IS NULL THEN 'no_reference_value' WHEN mea IS NULL THEN 'missed_particle'
                 WHEN status = 'ambiguous' THEN 'flagged_ambiguous' ELSE 'matched' END AS reason FROM val)"""


def long_val(spark, d, keep=("image_id", "particle_id", "part", "morphology", "mode", "status")) -> DataFrame:
    from granulate.operators.agreement import melt

    return melt(val(spark, d), ["diameter"], list(keep))


def outline(spark, d) -> DataFrame:
    """image_id, seq and a quadrilateral around each detection."""
    x, y, r = F.col("cx"), F.col("cy"), F.col("radius_px")
    return det(spark, d).withColumn("polygon", F.array(x - r, y, x, y - r / 2, x + r, y, x, y + r))


OUTLINE = DET + ", outl AS (SELECT *, [cx - radius_px, cy, cx, cy - radius_px / 2, cx + radius_px, cy, cx, cy + radius_px] AS polygon FROM det)"
