"""Raster queries over phantoms: one made frame a customer, whose discs, bars and labels SQL can count pixel by pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from granulate.functions import geometry as g
from granulate.operators import backends, pairing, raster
from granulate.session import read

SIDE = 64
IMG = ["image_id"]


def _frames(spark, d, kind: str):
    """image_id, width, height, data: a dark disc, a bright bar, or a square label of 1 to 3 per frame."""
    k = F.col("c_custkey")
    p = read(spark, d, "customer").select(k.alias("image_id"), (20 + k % 24).alias("cx"), (20 + k * 7 % 24).alias("cy"), (4 + k % 12).alias("r"))
    # Few bytes a row become a frame each, and a file of one row group is one task however it is split: so the keys are dealt out.
    p = p.repartition(max(4 * spark.sparkContext.defaultParallelism, p.rdd.getNumPartitions()), "image_id")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, cx, cy, r in pdf.itertuples(index=False):
                if kind == "disc":
                    f = raster.disc_frame(SIDE, SIDE, [(cx, cy, r)])
                else:
                    f = np.full((SIDE, SIDE), 90 if kind == "bar" else 0, np.uint8)
                    if kind == "bar":
                        f[cy : cy + 1 + r % 3, cx : cx + 15 + r] = 255
                    else:
                        f[cy : cy + r, cx : cx + r + 2] = 1 + r % 3
                rows.append((i, SIDE, SIDE, f.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "data"])

    return p.mapInPandas(draw, "image_id long, width int, height int, data binary")


def phantom_discs(spark, d):
    """Discs found by the classical back-end: one a frame, with its exact area and centre."""
    r = backends.predict("classical", _frames(spark, d, "disc"))
    return r.select("image_id", "seq", "area_px", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "x", "y", "w", "h")


def phantom_bars(spark, d):
    """Bright bars that may be scale bars, ranked by confidence."""
    c = raster.scale_bars(_frames(spark, d, "bar"))
    return pairing.scale_candidates(c, IMG).select("image_id", "rank", "x", "y", "w", "h", "confidence")


def phantom_polygons(spark, d):
    """Outlines of labelled squares: corners and area of the polygon through the border pixels."""
    m = raster.mask_polygons(_frames(spark, d, "label"))
    return m.select("image_id", "label", (F.size("polygon") / 2).cast("int").alias("corners"), F.round(g.polygon_area(F.col("polygon")), 6).alias("area"), F.array_min("polygon").alias("least"))


NAMES = [phantom_discs, phantom_bars, phantom_polygons]
QUERIES = {f.__name__: f for f in NAMES}
P = "p AS (SELECT c_custkey AS image_id, 20 + c_custkey % 24 AS cx, 20 + c_custkey * 7 % 24 AS cy, 4 + c_custkey % 12 AS r FROM customer)"
ORACLES = {
    "phantom_discs": f"""WITH {P}, s AS (SELECT unnest(range(0, 64)) AS v), q AS (SELECT image_id, a.v AS x, b.v AS y FROM p, s a, s b WHERE (a.v - cx) * (a.v - cx) + (b.v - cy) * (b.v - cy) <= r * r)
      SELECT image_id, 1 AS seq, CAST(count(*) AS DOUBLE) AS area_px, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM q GROUP BY image_id""",
    "phantom_bars": f"""WITH {P}, b AS (SELECT image_id, cx AS x, cy AS y, least(64, cx + 15 + r) - cx AS w, 1 + r % 3 AS h FROM p)
      SELECT image_id, 1 AS rank, x, y, w, h, round_even(greatest(0, 0.45::DOUBLE * least(1, w / greatest(64 * 0.18::DOUBLE, 1)) + 0.25::DOUBLE * least(1, y / greatest(64 * 0.85::DOUBLE, 1)) + 0.2::DOUBLE * least(1, x / greatest(64 * 0.65::DOUBLE, 1)) + 0.1::DOUBLE * least(1, (w / h) / 12)), 4) AS confidence
      FROM b WHERE w >= 20 AND w / h > 6""",
    "phantom_polygons": f"WITH {P} SELECT image_id, 1 + r % 3 AS label, 4 AS corners, round(CAST((r - 1) * (r + 1) AS DOUBLE), 6) AS area, CAST(least(cx, cy) AS DOUBLE) AS least FROM p",
}
