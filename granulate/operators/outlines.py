"""Annotation outlines (COCO documents): flattening, class mapping, metrology, label export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions import geometry as g
from granulate.functions import text as t

CLASSES = ("Au_core", "SiO2_outer")


def images_of(doc: DataFrame) -> DataFrame:
    """Image rows of a document; keys of the image win over those of its metadata."""
    i = doc.select(F.explode("images").alias("i"))
    meta = F.col("i.metadata")
    keys = ("source_id", "nm_per_px", "split", "file_sha256", "license")
    have = set(doc.schema["images"].dataType.elementType.names)
    pick = lambda k: F.coalesce(*([F.col(f"i.{k}").cast("string")] if k in have else []), *([F.try_element_at(meta, F.lit(k))] if "metadata" in have else []), F.lit(None).cast("string"))
    return i.select("i.id", "i.file_name", "i.width", "i.height", *[pick(k).alias(k) for k in keys])


def annotations_of(doc: DataFrame) -> DataFrame:
    """Annotation rows of a document with their class name."""
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    c = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    return a.join(c, "category_id", "left")


def category_map(names: DataFrame) -> DataFrame:
    """category, class, class_id; unknown labels have no class_id."""
    c = t.class_name(F.col("category"))
    known = F.create_map(*[F.lit(x) for i, n in enumerate(CLASSES) for x in (n, i)])
    return names.select("category", c.alias("class"), F.try_element_at(known, c).alias("class_id"))


def measured(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, seq, class, area, centroid and diameter (nm) of each outline; run lengths and unknown classes are left out."""
    p = g.first_polygon(F.col("segmentation"))
    a = annotations.withColumn("polygon", p).where("polygon is not null").join(category_map(annotations.select("category").distinct()), "category").where("class_id is not null")
    j = a.join(images.select(F.col("id").alias("image_id"), F.coalesce(F.col("nm_per_px").try_cast("double"), F.lit(0.0)).alias("nm_per_px")), "image_id")
    area = g.polygon_area(F.col("polygon"))
    c = g.polygon_centroid(F.col("polygon"))
    return j.select("image_id", F.col("id").alias("seq"), "class", area.alias("area_px"), c["x"].alias("cx"), c["y"].alias("cy"), g.physical_diameter(area, F.col("nm_per_px")).alias("diameter_nm"), "nm_per_px")


def core_shell(rows: DataFrame) -> DataFrame:
    """Core, total diameter and shell of each outer outline, paired with its nearest free core; cores left over are not rows."""
    from granulate.operators.pairing import pair_any

    outer, core = rows.where("class = 'SiO2_outer'"), rows.where("class = 'Au_core'")
    pairs = pair_any(outer, core, ["image_id"])
    j = outer.withColumnRenamed("seq", "a").join(pairs, ["image_id", "a"], "left").join(core.select("image_id", F.col("seq").alias("b"), F.col("diameter_nm").alias("core_nm")), ["image_id", "b"], "left")
    return j.select(
        "image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("a")).alias("object_no"), F.coalesce("core_nm", F.lit(0.0)).alias("core_nm"),
        F.col("diameter_nm").alias("total_nm"), F.when(F.col("core_nm") != 0, F.greatest(F.lit(0.0), (F.col("diameter_nm") - F.col("core_nm")) / 2)).alias("shell_nm"),
        F.when(F.col("b").isNotNull(), "paired").otherwise("missing_core").alias("pair_status"), F.col("d").alias("centre_distance_px"),
    )


def label_lines(annotations: DataFrame, images: DataFrame, digits: int = 6) -> DataFrame:
    """Text lines `class x1 y1 ...` with vertices as shares of the frame; review flags, bad outlines and unknown classes are skipped (see skipped)."""
    rows = _checked(annotations, images)
    ok = rows.where("reason is null")
    line = F.concat_ws(" ", F.col("class_id").cast("string"), F.array_join(F.transform("unit", lambda v: F.format_string(f"%.{digits}f", v)), " "))
    return ok.select("image_id", "id", line.alias("line"))


def skipped(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Skipped annotations by reason."""
    return _checked(annotations, images).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def _checked(annotations: DataFrame, images: DataFrame) -> DataFrame:
    have = annotations.columns
    status = [F.col(c) for c in ("review_status", "status", "quality_status") if c in have]
    review = t.needs_review(*status, crowd=F.col("iscrowd") if "iscrowd" in have else None)
    a = annotations.join(category_map(annotations.select("category").distinct()), "category", "left")
    j = a.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id", "left")
    unit = g.polygon_normalise(g.first_polygon(F.col("segmentation")), F.col("width"), F.col("height"))
    return j.withColumn("unit", unit).withColumn(
        "reason",
        F.when(F.col("width").isNull(), "no image").when(F.col("class_id").isNull(), "unknown category").when(review, "needs review")
        .when(F.col("unit").isNull(), "no usable outline"),
    )
