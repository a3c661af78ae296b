"""Audits of curation tables: provenance, splits, layers, milestones. Every finding is a row with its rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulate.functions import layers as ly
from granulate.functions import text as t
from granulate.operators.curation import blank, last_by, missing_fields

SPLITS = ("train", "val", "test")
IMAGE_FIELDS = ["source_id", "file_path", "source_url", "license", "file_sha256", "width", "height", "modality", "quality_status"]


def with_source(images: DataFrame, sources: DataFrame) -> DataFrame:
    """Images with `src`, the last row (by row_no) of their source; the id is compared as written."""
    s = last_by(sources.where(~blank("source_id")), ["source_id"], [F.col("row_no")])
    return images.join(s.select("source_id", F.struct("*").alias("src")), "source_id", "left")


def image_layers(images: DataFrame, sources: DataFrame) -> DataFrame:
    """row_no, training_layer, dataset_layer, distribution_layer, content_layer, confirmed_scale."""
    j = with_source(images, sources)
    lic = lambda p: t.public_licence(F.col(f"{p}license_status") if p else F.lit(""), F.col(f"{p}license"), F.col(f"{p}license_url") if p else F.lit(""))
    own, src = lic(""), F.coalesce(lic("src."), F.lit(False)) & F.col("src").isNotNull()
    public = own | src
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (F.col("caption"), F.col("notes"), F.col("src.title"), F.col("src.abstract"), F.col("src.keywords"))])
    kind, notes = F.col("src.source_type"), F.col("notes")
    return j.select(
        "row_no", ly.training_layer(public, kind, notes).alias("training_layer"), ly.dataset_layer(public, kind, notes).alias("dataset_layer"),
        ly.distribution_layer(own, src).alias("distribution_layer"), t.content_layer(F.lit(""), text).alias("content_layer"),
        ly.has_confirmed_scale(F.col("scale_status"), F.col("nm_per_px")).alias("confirmed_scale"),
    )


def layer_counts(layers: DataFrame) -> DataFrame:
    """Images per pair of labels, written content / distribution."""
    return layers.groupBy(F.concat_ws(" / ", "content_layer", "distribution_layer").alias("layer")).agg(F.count("*").alias("images"))


def readiness(images: DataFrame, sources: DataFrame) -> DataFrame:
    """row_no, missing (names joined by commas), metadata_status: ready, blocked by the source's licence, or needs_manual_review."""
    j = with_source(images, sources)
    status = F.when(F.col("src").isNotNull(), t.licence_status(F.concat_ws(" ", F.coalesce("src.license", F.lit("")), F.coalesce("src.license_url", F.lit("")))))
    status = F.when(F.col("src").isNotNull() & (F.trim(F.concat(F.coalesce("src.license", F.lit("")), F.coalesce("src.license_url", F.lit("")))) == ""), "missing").otherwise(status)
    lost = missing_fields(IMAGE_FIELDS, {"caption_or_notes": blank("caption") & blank("notes"), "accepted_source_license": F.coalesce(status, F.lit("")) != "accepted"})
    r = j.select("row_no", lost.alias("m"), status.alias("s"), ((F.col("curation_status") == "accepted") & (F.col("scale_status") == "confirmed") & ~blank("nm_per_px")).alias("done"))
    return r.select(
        "row_no", F.array_join("m", ",").alias("missing"),
        F.when(F.col("done") & (F.size("m") == 0), "ready").when(F.coalesce("s", F.lit("")).isin("", "accepted"), "needs_manual_review").otherwise("blocked").alias("metadata_status"),
    )


def counters(tests: dict[str, Column], df: DataFrame) -> DataFrame:
    """name, n: how many rows pass each test, in one pass."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return row.select(F.explode(F.create_map(*[x for n in tests for x in (F.lit(n), F.col(n))])).alias("name", "n"))


def dataset_gaps(rows: DataFrame, group: Column, layer: Column) -> DataFrame:
    """kind, name, n: rows per split and layer, provenance gaps, and groups that lie in several splits. One pass but for the groups."""
    both = lambda a, b: blank(a) & blank(b)
    marks = F.array_compact(F.array(
        F.struct(F.lit("split").alias("kind"), F.coalesce("split", F.lit("")).alias("name")), F.struct(F.lit("layer").alias("kind"), layer.alias("name")),
        *[F.when(c, F.struct(F.lit("gap").alias("kind"), F.lit(n).alias("name"))) for n, c in {
            "missing_calibration": blank("nm_per_px"), "missing_license": both("license", "license_status"), "missing_source": both("source_url", "doi"), "missing_checksum": blank("file_sha256"),
        }.items()],
    ))
    per = rows.select(F.explode(marks).alias("m")).groupBy("m.kind", "m.name").agg(F.count("*").alias("n"))
    torn = rows.select(group.alias("g"), F.coalesce("split", F.lit("")).alias("s")).groupBy("g").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return per.unionByName(torn.agg(F.count_if(F.col("a") != F.col("b")).alias("n")).select(F.lit("error").alias("kind"), F.lit("groups_in_several_splits").alias("name"), "n"))


def split_findings(rows: DataFrame, group: Column, layer: Column, exact_test: bool = True, require_test: bool = True) -> DataFrame:
    """severity, rule, subject, n: bad splits, test rows that are not exact, groups in several splits, checksums of several rows, a missing test split."""
    split = F.coalesce("split", F.lit(""))
    bad = rows.where(~split.isin(*SPLITS)).groupBy(split.alias("subject")).agg(F.count("*").alias("n")).select(F.lit("error").alias("severity"), F.lit("bad_split").alias("rule"), "subject", "n")
    torn = rows.where(split != "").groupBy(group.alias("subject")).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("error").alias("severity"), F.lit("group_in_several_splits").alias("rule"), "subject", "n")
    sums = rows.where(~blank("file_sha256")).groupBy(F.col("file_sha256").alias("subject")).agg(F.count("*").alias("n"), (F.min(split) != F.max(split)).alias("across")).where("n > 1")
    same = sums.select(F.when(F.col("across"), "error").otherwise("warning").alias("severity"), F.lit("duplicate_checksum").alias("rule"), "subject", "n")
    out = bad.unionByName(torn).unionByName(same)
    if exact_test:
        inexact = rows.where((split == "test") & (layer != "real_exact")).groupBy(layer.alias("subject")).agg(F.count("*").alias("n"))
        out = out.unionByName(inexact.select(F.lit("error").alias("severity"), F.lit("inexact_test").alias("rule"), "subject", "n"))
    if require_test:
        none = rows.agg(F.count_if(split == "test").alias("n")).where("n = 0")
        out = out.unionByName(none.select(F.lit("error").alias("severity"), F.lit("no_test_split").alias("rule"), F.lit("test").alias("subject"), "n"))
    return out


def milestones(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """name, passes, reached: each target held against one row of totals; reached marks the largest one that passes.

    totals: images, sources, real_exact. targets: place, name, min_images, min_sources, min_real_exact (a handful of rows).
    """
    j = targets.join(F.broadcast(totals))  # one row
    checks = {c: F.col(c) >= F.col(f"min_{c}") for c in ("images", "sources", "real_exact")}
    p = j.select("place", "name", *[v.alias(f"{k}_pass") for k, v in checks.items()], reduce(lambda a, b: a & b, checks.values()).alias("passes"))
    best = p.agg(F.max_by("name", F.when(F.col("passes"), F.col("place"))).alias("best"), F.count_if("passes").alias("k"))
    return p.join(F.broadcast(best)).select("name", *[f"{k}_pass" for k in checks], "passes", ((F.col("k") > 0) & (F.col("name") == F.col("best"))).alias("reached"))


def coco_template(images: DataFrame, sources: DataFrame, public_only: bool = False) -> DataFrame:
    """Image entries of an annotation template: accepted images, their id being the place (from 1) in the whole list."""
    from granulate.operators.ordering import placed

    rows = placed(images, ["row_no"]).withColumn("id", F.col("place") + 1).where("curation_status = 'accepted'")
    j = with_source(rows, sources)
    out = j.select(
        "row_no", "id", F.regexp_replace("file_path", r"\\", "/").alias("file_name"), *[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in ("width", "height")],
        "image_id", "source_id", F.coalesce("src.license_status", F.lit("")).alias("license_status"), F.when(blank("split"), "train").otherwise(F.col("split")).alias("split"),
        F.coalesce("src.doi", F.lit("")).alias("doi"), F.coalesce("src.title", F.lit("")).alias("title"),
    ).join(image_layers(images, sources).select("row_no", "dataset_layer"), "row_no").drop("row_no")
    return out.where("dataset_layer = 'public_demo'") if public_only else out


def merged_metadata(images: DataFrame, levels: list[tuple[DataFrame, str]], fields: list[str]) -> DataFrame:
    """`fields` of each image from the last of several lookups that has its key, the image itself coming last.

    levels: (lookup table, its key, which the images have too), the weakest first. A value of a stronger level counts even if it is blank.
    """
    out = images
    for i, (table, key) in enumerate(levels):
        out = out.join(table.select(key, F.struct(*[f for f in fields if f in table.columns]).alias(f"_l{i}")), key, "left")
    for f in fields:
        value = F.lit(None).cast("string")
        for i, (table, _) in enumerate(levels):
            if f in table.columns:
                value = F.when(F.col(f"_l{i}").isNotNull(), F.col(f"_l{i}.{f}")).otherwise(value)
        out = out.withColumn(f, F.col(f) if f in images.columns else value)
    return out.drop(*[f"_l{i}" for i in range(len(levels))])
