"""Records between detection and report: scale, detections, objects without partners, comparisons, plot data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulate.functions import geometry as g


def resolve_scale(images: DataFrame, candidates: DataFrame, by: list[str], padding: int = 8) -> DataFrame:
    """by, method, width_px, nm_per_px and the ignored region x, y, w, h: a manual line, else a manual width, else the best candidate.

    images: by, width, height, scale_nm, manual_px, line (struct x1, y1, x2, y2, or NULL). candidates: by, seq, x, y,
    width_px, height_px, confidence. An image with none of them has method `none` and no scale; nothing is dropped.
    """
    best = candidates.groupBy(*by).agg(F.max_by(F.struct("x", "y", "width_px", "height_px"), F.struct("confidence", (-F.col("seq")).alias("s"))).alias("best"))
    j = images.join(best, by, "left")
    line, b = F.col("line"), F.col("best")
    x = F.greatest(F.lit(0), F.floor(F.least(line["x1"], line["x2"])) - padding)
    y = F.greatest(F.lit(0), F.floor(F.least(line["y1"], line["y2"])) - padding)
    w = F.greatest(F.lit(1), F.least(F.col("width"), F.ceil(F.greatest(line["x1"], line["x2"])) + padding) - x)
    h = F.greatest(F.lit(1), F.least(F.col("height"), F.ceil(F.greatest(line["y1"], line["y2"])) + padding) - y)
    method = F.when(line.isNotNull(), "manual_line").when(F.col("manual_px") > 0, "manual_override").when(b.isNotNull(), "candidate").otherwise("none")
    width = F.when(line.isNotNull(), g.distance(line["x1"], line["y1"], line["x2"], line["y2"])).when(F.col("manual_px") > 0, F.col("manual_px")).when(b.isNotNull(), b["width_px"])
    region = lambda manual, auto: F.when(line.isNotNull(), manual).when((F.coalesce("manual_px", F.lit(0)) <= 0) & b.isNotNull(), auto).cast("double")
    return j.select(
        *by, method.alias("method"), width.alias("width_px"), F.try_divide("scale_nm", width).alias("nm_per_px"),
        region(x, F.floor(b["x"])).alias("x"), region(y, F.floor(b["y"])).alias("y"),
        region(w, F.bround(b["width_px"], 0)).alias("w"), region(h, F.greatest(F.lit(1), F.bround(b["height_px"], 0))).alias("h"),
    )


def detection(major_px: Column, minor_px: Column, area_px: Column, nm_per_px: Column, confidence: Column) -> Column:
    """Calibrated record of a detection: axes and diameters in nm, aspect ratio and confidence to four places."""
    return F.struct(
        (major_px * nm_per_px).alias("diameter"), (minor_px * nm_per_px).alias("minor_axis"), (g.equivalent_diameter(area_px) * nm_per_px).alias("equivalent_diameter"),
        (major_px / 2).alias("radius_px"), F.round(g.aspect_ratio(major_px, minor_px), 4).alias("aspect_ratio"), F.round(confidence, 4).alias("confidence_hint"),
    )


def accept_circles(circles: DataFrame, by: list[str], frame_share: float = 0.25) -> DataFrame:
    """Circles of at most a share of the frame that do not touch its edge; then those inside one kept before are dropped.

    circles: by, seq, cx, cy, radius_px, width, height.
    """
    from granulate.operators.pairing import deduplicate

    r = F.col("radius_px")
    small = F.lit(3.141592653589793) * r * r <= frame_share * F.col("width") * F.col("height")
    inside = (F.col("cx") - r > 0) & (F.col("cy") - r > 0) & (F.col("cx") + r < F.col("width")) & (F.col("cy") + r < F.col("height"))
    return deduplicate(circles.where(small & inside).select(*by, "seq", "cx", "cy", "radius_px"), by)


def backend_summary(rows: DataFrame, backend: str = "backend") -> DataFrame:
    """Images and mean iou, dice and seconds per back-end."""
    return rows.groupBy(backend).agg(F.count("*").alias("images"), *[F.round(F.avg(c), 9).alias(f"mean_{c}") for c in ("iou", "dice", "seconds")])


def truth_comparison(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """by, true_particles, detected_objects, both mean diameters (to six places) and their ratio; truth and found have by and diameter.

    A diameter of 0 or NULL counts as an object, not for the mean. Images on one side only are kept.
    """
    known = F.when(F.col("diameter") > 0, F.col("diameter"))
    a = truth.groupBy(*by).agg(F.count("*").alias("true_particles"), F.round(F.avg("diameter"), 6).alias("true_mean"))
    b = found.groupBy(*by).agg(F.count("*").alias("detected_objects"), F.round(F.avg(known), 6).alias("detected_mean"))
    return a.join(b, by, "full").select(
        *by, F.coalesce("true_particles", F.lit(0)).alias("true_particles"), F.coalesce("detected_objects", F.lit(0)).alias("detected_objects"),
        "true_mean", "detected_mean", F.round(F.try_divide("detected_mean", "true_mean"), 6).alias("mean_ratio"),
    )


def identity_limits(rows: DataFrame, by: list[str], ref: str, mea: str) -> DataFrame:
    """by, low, high of the identity line: the range of both series and five percent more on each side (of 1 if it is a point)."""
    low, high = F.min(F.least(ref, mea)), F.max(F.greatest(ref, mea))
    pad = 0.05 * F.when(high - low == 0, 1.0).otherwise(high - low)
    return rows.where(F.col(ref).isNotNull() & F.col(mea).isNotNull()).groupBy(*by).agg((low - pad).alias("low"), (high + pad).alias("high"))


def residual_bins(rows: DataFrame, by: list[str], difference: str) -> DataFrame:
    """by, bin, n: equal-width histogram of the differences, with a third as many bins as values, 6 to 30; the last bin is closed."""
    d = F.col(difference)
    size = rows.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("k"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    third = F.floor(F.col("k") / 3)
    size = size.withColumn("bins", F.greatest(F.lit(6), F.least(F.lit(30), F.when(third == 0, 6).otherwise(third)))).select(
        *by, "bins", F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi") == F.col("lo"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")
    )
    at = F.least(F.col("bins") - 1, F.floor((d - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")))
    return rows.where(d.isNotNull()).join(size, by).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def first_match(left: DataFrame, files: DataFrame, stem: str, suffix: str, order: tuple[str, ...] = (".png", ".tif", ".tiff", ".bmp")) -> DataFrame:
    """left with `match`, the suffix found for its stem that comes first in `order`; other suffixes do not count."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(suffix))
    best = files.withColumn("r", rank).where("r > 0").groupBy(stem).agg(F.min_by(suffix, "r").alias("match"))
    return left.join(best, stem, "left")


def class_names(categories: DataFrame, name: str, requested: list[str] | None = None) -> list[str]:
    """Requested names that all exist, else `particle`, else the only name; anything else is an error. Categories are a short list."""
    wanted = [*(requested or []), "particle"]
    c = categories.select(F.trim(F.coalesce(F.col(name), F.lit(""))).alias("n")).where("n != ''").distinct()
    known = {r["n"] for r in c.where(F.col("n").isin(wanted)).collect()}
    if requested:
        if lost := [n for n in requested if n not in known]:
            raise ValueError(f"classes missing from the categories: {lost}")
        return list(requested)
    if "particle" in known:
        return ["particle"]
    some = [r["n"] for r in c.limit(2).collect()]  # one name is enough, two are too many
    if len(some) != 1:
        raise ValueError("no single class can be inferred; name one")
    return some


def category_map(categories: DataFrame, key: str, name: str, names: list[str]) -> DataFrame:
    """key and class_id (place in `names`) of the categories that bear one of the names."""
    ids = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return categories.select(key, F.try_element_at(ids, F.trim(F.coalesce(F.col(name), F.lit("")))).alias("class_id")).where("class_id is not null")


def pairs_are_sound(rows: DataFrame, ref: str, mea: str) -> DataFrame:
    """The rows themselves; an empty table, a NULL or an infinite value is an error when they are read."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(ref).isNull() | F.col(mea).isNull() | F.isnan(ref) | F.isnan(mea) | (F.abs(ref) == float("inf")) | (F.abs(mea) == float("inf"))).alias("bad"))
    check = n.select(F.when(F.col("n") == 0, F.raise_error(F.lit("no pairs"))).when(F.col("bad") > 0, F.raise_error(F.concat(F.lit("pairs that are not finite: "), F.col("bad").cast("string")))).otherwise(True).alias("sound"))
    return rows.join(F.broadcast(check)).where("sound").drop("sound")
