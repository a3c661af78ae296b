"""Queries of readers and writers (round trips through the shared folder), names and numbers, boxes and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.functions import geometry as g
from granulate.functions import text as t
from granulate.functions.normalise import let
from granulate.operators import outlines, pairing, records
from granulate.plans import measurement
from granulate.plans.curation import _any
from granulate.plans.views import DET, OUTLINE, VAL, det, outline, val
from granulate.session import read, shared_folder
from granulate.sources import sinks, tables

IMG = ["image_id"]
TEXT = ["row_no", "source_id", "title", "authors", "keywords", "license"]


def csv_round_trip(spark, d):
    """Sources written as CSV and read with fixed columns: missing ones blank, NULL as blank, quotes and line breaks kept."""
    path = shared_folder(spark, "csv")
    sinks.write_csv(read(spark, d, "sources"), path, [*TEXT, "absent"])
    return tables.csv_fixed(spark, path, [*TEXT, "absent", "unknown"])


def manifest_round_trip(spark, d):
    """Images written in a folder a split; one split read back."""
    path = shared_folder(spark, "manifest")
    sinks.write_manifest(read(spark, d, "images").select("row_no", "image_id", F.coalesce(F.lower("split"), F.lit("none")).alias("split")).where("split in ('train', 'val', 'test', 'none')"), path)
    return spark.read.parquet(path).where("split = 'val'").select("row_no", "image_id", "split")


def validation_round_trip(spark, d):
    path = shared_folder(spark, "validation")
    v = val(spark, d).select("image_id", "particle_id", "part", "status", F.col("reference_diameter").cast("string").alias("reference_diameter_nm"), F.coalesce(F.col("measured_diameter").cast("string"), F.lit("n/a")).alias("measured_diameter_nm"))
    sinks.write_csv(v.withColumnRenamed("part", "notes"), path)
    r = tables.validation_table(spark, path)
    return r.select("image_id", "particle_id", "notes", "status", F.round("reference_diameter", 9).alias("reference"), F.round("measured_diameter", 9).alias("measured"))


def label_round_trip(spark, d):
    """Outlines of detections written as label lines, read and checked again."""
    images, notes = _document(spark, d)
    path = shared_folder(spark, "labels")
    outlines.label_lines(notes, images).select("line").write.text(path)
    r = tables.labels(spark, path)
    return r.groupBy("class_id").agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.round(F.sum(F.get("points", F.lit(0))), 2).alias("x"))


def _document(spark, d):
    """Images and annotations of a document whose outlines are those of the detections."""
    v = outline(spark, d)
    images = v.select("image_id").distinct().select(F.col("image_id").alias("id"), F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit("0.5").alias("nm_per_px"))
    label = F.when(F.col("seq") == 5, "dirt").when(F.col("class") == "inner", "gold core").otherwise("Silica-shell").alias("category")
    notes = v.select("image_id", F.col("seq").alias("id"), label, F.array("polygon").alias("segmentation"), F.when(F.col("seq") == 6, "needs_review").alias("review_status"), F.lit(0).alias("iscrowd"))
    return images, notes


def skipped_annotations(spark, d):
    images, notes = _document(spark, d)
    return outlines.skipped(notes, images)


def outline_measures(spark, d):
    images, notes = _document(spark, d)
    return outlines.measured(notes, images).select("image_id", "seq", "class", F.round("area_px", 6).alias("area_px"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("diameter_nm", 6).alias("diameter_nm"))


def preferred_diameters(spark, d):
    v = det(spark, d).withColumn("diameter", F.col("radius_px") * 2)
    return sinks.diameters(v, IMG, "outer")


def truth_matches(spark, d):
    """Outer detections are the truth, inner ones what was found."""
    v = det(spark, d).withColumn("diameter", F.col("radius_px") * 4)
    return pairing.match_truth(v.where("class = 'outer'"), v.where("class = 'inner'"), IMG, "diameter").select("image_id", "a", "b", F.round("d", 6).alias("d"))


def picture_names(spark, d):
    i = read(spark, d, "images")
    name, path = F.coalesce("original_file_name", F.lit("")), F.coalesce("file_path", F.lit(""))
    return i.select(
        "row_no", t.safe_stem(name).alias("stem"), t.safe_slug(path, 20).alias("slug"), F.round(t.number(F.col("nm_per_px")), 6).alias("scale"), g.truthy(F.coalesce("quality_status", F.lit(""))).alias("flag"),
        t.keep_image(F.coalesce("source_url", F.lit("")), F.col("caption")).alias("kept"), t.leakage_group(i.columns, "image_id").alias("grp"), t.relative_to(path, "data").alias("below"),
        t.hamming(F.col("ahash"), F.reverse("ahash")).cast("double").alias("turned"), t.figure(t.number(F.col("nm_per_px"))).alias("shown"), F.round(g.nm_per_pixel(t.number(F.col("scale_nm")), t.number(F.col("scale_px"))), 6).alias("calibrated"),
    )


def source_names(spark, d):
    s = read(spark, d, "sources")
    url = F.coalesce("url", F.lit(""))
    return s.select(
        "row_no", t.zenodo_id(url).alias("zenodo"), t.figshare_id(url).alias("figshare"), t.class_name(F.col("modality")).alias("label"), F.size(t.key_values(F.concat_ws(";", F.concat(F.lit("doi="), F.coalesce("doi", F.lit(""))), F.concat(F.lit(" year = "), F.coalesce("year", F.lit("")))))).alias("pairs"),
        t.needs_review(F.col("status"), F.col("decision")).alias("review"),
    )


def triage_folders(spark, d):
    f = read(spark, d, "figure_triage")
    return f.groupBy("classification").agg(F.count("*").alias("n")).select(t.class_folder(F.col("classification")).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n"))


def class_ids(spark, d):
    """Categories that bear a requested name, with its place."""
    c = read(spark, d, "figure_triage").where("classification is not null").groupBy(F.col("classification").alias("category")).agg(F.min("tile_no").alias("first_tile"))
    return records.category_map(c, "first_tile", "category", records.class_names(c, "category", ["graph", "tem"]))


def _box(b):
    return F.array_join(F.transform(b, lambda x: F.concat_ws(",", *[x[k].cast("string") for k in ("x1", "y1", "x2", "y2")])), " ")


def panel_boxes(spark, d):
    """Strips by aspect, halves, quarters and boxes between gutters as text."""
    e = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 40 + 100).cast("int").alias("w"), (F.col("l_suppkey") * 7 % 900 + 200).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    xs, ys = F.when(F.col("l_partkey") % 3 == 0, F.array(F.floor(w / 2).cast("int"), F.floor(w / 4).cast("int"))).otherwise(F.array().cast("array<int>")), F.when(F.col("l_partkey") % 2 == 0, F.array(F.floor(h / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    return e.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(_box(g.aspect_panels(w, h)), F.lit("")).alias("strips"), _box(g.halves(w, h)).alias("halves"), _box(g.quarters(w, h)).alias("quarters"), F.coalesce(_box(g.boxes_at(w, h, xs, ys)), F.lit("")).alias("panels"),
    )


def manual_inputs(spark, d):
    """Typed scale lines, filter ranges and the watershed switch; the ellipse of each detection as an outline."""
    v = det(spark, d)
    line = g.scale_line(F.concat_ws(",", F.col("cx").cast("int").cast("string"), F.lit(" 3"), F.when(F.col("seq") == 2, "x").otherwise(F.col("cy").cast("int").cast("string")), F.lit("7 ")))
    rng = g.clamped_range(F.col("cx") - 100, F.col("cy") - 50, 0.0, 300.0)
    ell = g.ellipse_polygon(F.col("cx"), F.col("cy"), F.col("radius_px"), F.col("radius_px") / 2, F.lit(0.5), 12)
    return v.select(
        "image_id", "seq", F.round(line["length"], 6).alias("length"), rng["low"].alias("low"), rng["high"].alias("high"),
        g.watershed_on(F.when(F.col("seq") % 3 == 0, "auto").when(F.col("seq") % 3 == 1, "off").otherwise("yes"), F.when(F.col("class") == "inner", "pellets").otherwise("spheres")).alias("split"),
        let(ell, lambda p: F.struct(F.round(g.polygon_area(p), 4).alias("area"), F.round(F.get(p, F.lit(2)), 4).alias("x2"))).alias("e"),
    ).select("*", "e.*").drop("e")


def golden_rows(spark, d):
    """Detections and their outlines with every number of the record rounded to six places, as JSON with sorted keys."""
    v = outline(spark, d).select("image_id", "seq", "class", (F.col("radius_px") / 7).alias("radius"))
    rounded = v.select(*[F.round(c, 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in v.dtypes])
    return rounded.select("image_id", "seq", F.get_json_object(sinks.json_value(rounded), "$.radius").cast("double").alias("radius"), F.get_json_object(sinks.json_value(rounded), "$.class").alias("class"))


NAMES = [
    csv_round_trip, manifest_round_trip, validation_round_trip, label_round_trip, skipped_annotations, outline_measures, preferred_diameters, truth_matches, picture_names, source_names,
    triage_folders, class_ids, panel_boxes, manual_inputs, golden_rows,
]
QUERIES = {f.__name__: f for f in NAMES}

FINITE = "CASE WHEN lower(trim({x}, ' ')) NOT IN ('', 'na', 'n/a', 'nan', 'none', 'null') AND isfinite(TRY_CAST(trim({x}, ' ') AS DOUBLE)) THEN TRY_CAST(trim({x}, ' ') AS DOUBLE) END"
URLP = "lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
SUFFIXED = " OR ".join(f"ends_with({URLP}, '{s}') OR contains(a, '{s}?')" for s in t.IMAGE_SUFFIXES)
ORACLES = {
    "truth_matches": measurement._pairs("outer", "inner", "greatest(8, o.radius_px * 4 / 2 * 0.75::DOUBLE)"),
    "csv_round_trip": "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in TEXT) + ", '' AS absent, '' AS unknown FROM sources",
    "manifest_round_trip": "SELECT row_no, image_id, 'val' AS split FROM images WHERE lower(split) = 'val'",
    "validation_round_trip": f"WITH {VAL} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(particle_id AS VARCHAR) AS particle_id, CAST(part AS VARCHAR) AS notes, status, round(ref, 9) AS reference, round(mea, 9) AS measured FROM val",
    "label_round_trip": f"""WITH {OUTLINE}, n AS (SELECT *, [least(1, greatest(0, v / 512)) FOR v IN polygon] AS u FROM outl WHERE seq <> 5 AND seq <> 6 AND class = 'inner')
      SELECT 0 AS class_id, count(*) AS n, 0 AS bad, round(sum(round(u[1], 6)), 2) AS x FROM n""",
    "preferred_diameters": f"WITH {DET}, h AS (SELECT *, bool_or(class = 'outer') OVER (PARTITION BY image_id) AS has FROM det) SELECT image_id, seq, radius_px * 2 AS diameter FROM h WHERE class = 'outer' OR NOT has",
    "skipped_annotations": f"WITH {OUTLINE}, r AS (SELECT CASE WHEN seq = 5 OR class <> 'inner' THEN 'unknown category' WHEN seq = 6 THEN 'needs review' END AS reason FROM outl) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "picture_names": f"""WITH b AS (SELECT *, coalesce(original_file_name, '') AS f, coalesce(file_path, '') AS p, coalesce(source_url, '') AS u, lower(coalesce(source_url, '') || ' ' || coalesce(caption, '')) AS a, {FINITE.format(x='nm_per_px')} AS v, {FINITE.format(x='scale_nm')} AS sn, {FINITE.format(x='scale_px')} AS sp FROM images),
      c AS (SELECT *, regexp_replace(regexp_replace(f, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS st, regexp_replace(regexp_replace(p, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS sl FROM b)
      SELECT row_no, CASE WHEN st = '' THEN 'image' ELSE st END AS stem, CASE WHEN length(sl) > 20 THEN sl[1:20] || '_' || sha1(p)[1:8] ELSE sl END AS slug, round(v, 6) AS scale, lower(trim(coalesce(quality_status, ''), ' ')) NOT IN ('0', 'false', 'no', 'off') AS flag,
        ({SUFFIXED}) AND NOT {_any('a', t.IMAGE_BLOCKED)} AND {_any('a', t.IMAGE_WANTED)} AS kept, coalesce(nullif(trim(source_id, ' '), ''), nullif(trim(image_id, ' '), '')) AS grp, CASE WHEN starts_with(p, 'data/') THEN p[6:] ELSE p END AS below,
        CAST(CASE WHEN length(ahash) > 0 THEN hamming(ahash, reverse(ahash)) END AS DOUBLE) AS turned, CASE WHEN v IS NULL OR v = 0 THEN '' ELSE printf('%.4f', v) END AS shown, round(CASE WHEN sn > 0 AND sp > 0 THEN sn / sp END, 6) AS calibrated FROM c""",
    "source_names": f"""WITH b AS (SELECT *, coalesce(url, '') AS u FROM sources) SELECT row_no, regexp_extract(u, 'zenodo\\.org/(?:records|record)/(\\d+)', 1) AS zenodo, regexp_extract(u, '/(\\d+)(?:/\\d+)?/?$', 1) AS figshare, modality AS label, 2 AS pairs,
      coalesce(lower(trim(status, ' ')) IN ({", ".join(f"'{x}'" for x in t.REVIEW_STATUSES)}), false) OR coalesce(lower(trim(decision, ' ')) IN ({", ".join(f"'{x}'" for x in t.REVIEW_STATUSES)}), false) AS review FROM b""",
    "triage_folders": "SELECT CASE classification WHEN 'tem' THEN 'tem_candidates' WHEN 'graph' THEN 'graphs' WHEN 'abstract_or_scheme' THEN 'abstracts_or_schemes' WHEN 'mixed_figure' THEN 'mixed' ELSE 'needs_review' END AS folder, count(*) AS n FROM figure_triage GROUP BY 1",
    "class_ids": "SELECT min(tile_no) AS first_tile, CASE trim(classification, ' ') WHEN 'graph' THEN 0 ELSE 1 END AS class_id FROM figure_triage WHERE trim(classification, ' ') IN ('graph', 'tem') GROUP BY classification",
    "manual_inputs": f"""WITH {DET}, p AS (SELECT image_id, seq, class, cx, cy, radius_px AS r, CASE WHEN seq <> 2 THEN sqrt((floor(cy) - floor(cx)) * (floor(cy) - floor(cx)) + 16) END AS len, least(300, greatest(0, cx - 100)) AS a, least(300, greatest(0, cy - 50)) AS b FROM det)
      SELECT image_id, seq, round(nullif(len, 0), 6) AS length, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN seq % 3 = 0 THEN class <> 'inner' ELSE seq % 3 = 2 END AS split, round(0.5::DOUBLE * 12 * sin(2 * pi() / 12) * r * r / 2, 4) AS area,
        round(cx + r * cos(2 * pi() / 12) * cos(0.5::DOUBLE) - r / 2 * sin(2 * pi() / 12) * sin(0.5::DOUBLE), 4) AS x2 FROM p""",
    "golden_rows": f"WITH {DET} SELECT image_id, seq, round(radius_px / 7, 6) AS radius, class FROM det",
    "panel_boxes": """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * 40 + 100 AS INT) AS w, CAST(l_suppkey * 7 % 900 + 200 AS INT) AS h FROM lineitem),
      r AS (SELECT *, w / greatest(h, 1) AS q, [0, w // 4, w // 2, w] AS xs, [0, h // 3, h] AS ys FROM e), n AS (SELECT *, CASE WHEN q > 2.25 THEN least(4, greatest(2, CAST(round_even(q, 0) AS INT))) WHEN q < 0.44 THEN least(4, greatest(2, CAST(round_even(1 / q, 0) AS INT))) END AS k FROM r)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN q > 2.25 THEN array_to_string([printf('%d,0,%d,%d', CAST(round_even(i * (w / k), 0) AS INT), CAST(round_even((i + 1) * (w / k), 0) AS INT), h) FOR i IN range(0, k)], ' ') WHEN q < 0.44 THEN array_to_string([printf('0,%d,%d,%d', CAST(round_even(i * (h / k), 0) AS INT), w, CAST(round_even((i + 1) * (h / k), 0) AS INT)) FOR i IN range(0, k)], ' ') ELSE '' END AS strips,
        printf('0,0,%d,%d %d,0,%d,%d', w // 2, h, w // 2, w, h) AS halves, printf('0,0,%d,%d %d,0,%d,%d 0,%d,%d,%d %d,%d,%d,%d', w // 2, h // 2, w // 2, w, h // 2, h // 2, w // 2, h, w // 2, h // 2, w, h) AS quarters,
        CASE WHEN l_partkey % 3 = 0 THEN array_to_string([printf('%d,0,%d,%d', xs[i], xs[i + 1], h) FOR i IN range(1, 4)], ' ') WHEN l_partkey % 2 = 0 THEN array_to_string([printf('0,%d,%d,%d', ys[i], w, ys[i + 1]) FOR i IN range(1, 3)], ' ') ELSE '' END AS panels FROM n""",
}
ORACLES["outline_measures"] = f"""WITH {OUTLINE}, p AS (SELECT *, radius_px AS r FROM outl WHERE class = 'inner' AND seq <> 5)
  SELECT image_id, seq, 'Au_core' AS class, round(1.5::DOUBLE * r * r, 6) AS area_px, round(cx, 6) AS cx, round(cy + r / 8, 6) AS cy, round(2 * sqrt(1.5::DOUBLE * r * r / pi()) * 0.5::DOUBLE, 6) AS diameter_nm FROM p"""
