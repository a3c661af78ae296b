"""Queries of the audit family and of the records between detection and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.functions import text as t
from granulate.operators import audits, ordering, records
from granulate.plans.curation import LAYER_HINTS, _any, _blank, group_of
from granulate.plans.views import DET, VAL, det, val
from granulate.session import read

IMG = ["image_id"]
# The milestones of a dataset (least images, sources and exact images), smallest first.
TARGETS = [(0, "smoke", 5, 1, 0), (1, "pilot", 150, 2, 1), (2, "v0", 300, 3, 1), (3, "publication", 600, 3, 1)]


def _tables(spark, d):
    return read(spark, d, "images"), read(spark, d, "sources")


def image_layers(spark, d):
    return audits.image_layers(*_tables(spark, d))


def layer_counts(spark, d):
    return audits.layer_counts(image_layers(spark, d))


def metadata_readiness(spark, d):
    return audits.readiness(*_tables(spark, d))


def metadata_counters(spark, d):
    """The counters of the metadata report: images from their rows, sources from theirs."""
    i, s = _tables(spark, d)
    rows = i.join(audits.readiness(i, s).select("row_no", F.col("metadata_status").alias("state")), "row_no")
    status = t.licence_status(F.trim(F.concat_ws(" ", F.coalesce("license", F.lit("")), F.coalesce("license_url", F.lit("")))))
    return audits.counters({
        "images": F.lit(True), "images_missing_caption": audits.blank("caption") & audits.blank("notes"), "images_missing_scale": audits.blank("nm_per_px"),
        "images_missing_checksum": audits.blank("file_sha256"), "metadata_ready_images": F.col("state") == "ready",
    }, rows).unionByName(audits.counters({"sources": F.lit(True), "publication_ready_sources": status == "accepted", "license_blocked_sources": status == "rejected"}, s))


def state_summary(spark, d):
    i, s = _tables(spark, d)
    f = read(spark, d, "figure_triage")
    has = lambda c, v: F.col(c) == v
    return (
        audits.counters({"sources": F.lit(True), "accepted_sources": has("decision", "accepted"), "ready_sources": has("license_status", "accepted")}, s)
        .unionByName(audits.counters({
            "images": F.lit(True), **{f"{v}_images": has("curation_status", v) for v in ("accepted", "rejected", "needs_review")}, "calibrated": ~audits.blank("nm_per_px"),
            "ready_images": has("metadata_status", "ready"),
        }, i))
        .unionByName(audits.counters({
            "triage_rows": F.lit(True), **{f"triage_{v}": has("classification", v) for v in ("tem", "graph", "abstract_or_scheme", "mixed_figure", "needs_review")}, "triage_tiles": ~audits.blank("tile_path"),
        }, f))
    )


def _split_rows(spark, d):
    """Images with the columns the split audits read; doi and licence state come from the source."""
    i, s = _tables(spark, d)
    return audits.with_source(i, s).select(
        "row_no", "split", "file_sha256", "nm_per_px", "license", "source_url", F.col("src.license_status").alias("license_status"), F.col("src.doi").alias("doi"), group_of()
    ).join(image_layers(spark, d).select("row_no", "dataset_layer", "content_layer"), "row_no")


def dataset_audit(spark, d):
    return audits.dataset_gaps(_split_rows(spark, d), F.coalesce("grp", F.lit("")), F.col("dataset_layer"))


def split_findings(spark, d):
    return audits.split_findings(_split_rows(spark, d), F.coalesce("grp", F.lit("")), F.col("content_layer"))


def milestones(spark, d):
    i = read(spark, d, "images").select("row_no", group_of()).join(image_layers(spark, d).select("row_no", "content_layer"), "row_no")
    totals = i.agg(F.count("*").alias("images"), F.countDistinct("grp").alias("sources"), F.count_if(F.col("content_layer") == "real_exact").alias("real_exact"))
    return audits.milestones(totals, spark.createDataFrame(TARGETS, "place int, name string, min_images int, min_sources int, min_real_exact int"))


def coco_template(spark, d):
    return audits.coco_template(*_tables(spark, d))


def merged_metadata(spark, d):
    """Title, journal and year of an image: from the source by address, over it by id; blank values of the stronger level count."""
    i, s = _tables(spark, d)
    last = lambda k: audits.last_by(s.where(~audits.blank(k)), [k], [F.col("row_no")])
    i = i.select("row_no", "source_id", F.col("source_url").alias("url"))
    return audits.merged_metadata(i, [(last("url"), "url"), (last("source_id"), "source_id")], ["title", "journal", "year"]).select("row_no", "title", "journal", "year")


def every_nth_val(spark, d):
    return ordering.every_nth(read(spark, d, "orders"), "o_orderkey")


def scale_resolution(spark, d):
    """Orders are the images, their lineitems the candidates; some have a manual line or width."""
    k = F.col("o_orderkey")
    line = F.when(k % 7 == 0, F.struct((k % 100 + 0.5).alias("x1"), (k % 50 + 3.25).alias("y1"), (k % 100 + 120.0).alias("x2"), (k % 50 + 3.25).alias("y2")))
    images = read(spark, d, "orders").select(k.alias("image_id"), F.lit(512).alias("width"), F.lit(400).alias("height"), (k % 9 * 50.0).alias("scale_nm"), F.when(k % 5 == 0, F.col("o_totalprice") / 1000).alias("manual_px"), line.alias("line"))
    c = det(spark, d).where("class = 'inner'").select("image_id", "seq", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("radius_px") * 2 + 0.25).alias("width_px"), (F.col("radius_px") / 10).alias("height_px"), (F.col("seq") % 3).alias("confidence"))
    r = records.resolve_scale(images, c, IMG)
    return r.select("image_id", "method", F.round("width_px", 6).alias("width_px"), F.round("nm_per_px", 6).alias("nm_per_px"), "x", "y", "w", "h")


def detection_records(spark, d):
    v = det(spark, d)
    r = records.detection(F.col("radius_px") * 2, F.col("radius_px") * 1.5, F.col("radius_px") * F.col("radius_px") * 2, F.lit(0.37), F.col("seq") / 7)
    out = v.select("image_id", "seq", r.alias("r"))
    return out.select("image_id", "seq", *[F.round(f"r.{c}", 6).alias(c) for c in ("diameter", "minor_axis", "equivalent_diameter", "radius_px", "aspect_ratio", "confidence_hint")])


def circle_acceptance(spark, d):
    v = det(spark, d).withColumn("radius_px", F.col("radius_px") / 4).withColumn("width", F.lit(512)).withColumn("height", F.lit(512))
    return records.accept_circles(v, IMG).select("image_id", "seq")


def backend_summary(spark, d):
    """Return flags are the back-ends; discount, tax and quantity stand for iou, dice and seconds."""
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("backend"), (F.col("l_discount") * 10).alias("iou"), (F.col("l_tax") * 10).alias("dice"), F.col("l_quantity").alias("seconds"))
    return records.backend_summary(rows)


def truth_comparison(spark, d):
    v = det(spark, d).withColumn("diameter", F.col("radius_px") * 2)
    return records.truth_comparison(v.where("class = 'outer'"), v.where("class = 'inner'").withColumn("diameter", F.when(F.col("seq") != 1, F.col("diameter"))), IMG)


def identity_limits(spark, d):
    r = records.identity_limits(val(spark, d), ["morphology"], "reference_diameter", "measured_diameter")
    return r.select("morphology", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def residual_bins(spark, d):
    v = val(spark, d).withColumn("difference", F.round((F.col("measured_diameter") - F.col("reference_diameter")) * 1000, 0))
    return records.residual_bins(v, ["mode"], "difference")


def generic_objects(spark, d):
    """Detections of both classes as objects without partners, the inner ones first."""
    from granulate.operators.pairing import assemble

    v = det(spark, d)
    s = F.struct("cx", "cy", (F.col("radius_px") * 2).alias("major"), (F.col("radius_px") * 2).alias("minor"), (F.col("radius_px") * 2).alias("equivalent"), F.array().cast("array<string>").alias("flags"))
    none = F.lit(None).cast("struct<cx:double,cy:double,major:double,minor:double,equivalent:double,flags:array<string>>")
    inner = v.where("class = 'inner'").select("image_id", F.struct(F.lit(0).alias("r"), "seq").alias("place"), s.alias("inner"), none.alias("outer"))
    outer = v.where("class = 'outer'").select("image_id", F.struct(F.lit(1).alias("r"), "seq").alias("place"), none.alias("inner"), s.alias("outer"))
    o = assemble(inner.unionByName(outer).withColumn("flags", F.array().cast("array<string>")), IMG, "generic")
    return o.select("image_id", "object_id", "center_x", "center_y", "inner_major_axis", "outer_major_axis", "pair_status", "review_status", F.array_join("flags", "|").alias("flags"))


def mask_suffixes(spark, d):
    """Names of pictures with the file of the same stem whose suffix comes first."""
    parts = lambda c: (F.lower(F.regexp_extract(c, r"([^/\\]*?)(\.[A-Za-z]+)?$", 1)).alias("stem"), F.lower(F.regexp_extract(c, r"(\.[A-Za-z]+)$", 1)).alias("suffix"))
    files = read(spark, d, "images").where("file_path is not null").select(*parts(F.col("file_path")))
    left = read(spark, d, "images").where("original_file_name is not null").select("row_no", parts(F.col("original_file_name"))[0])
    return records.first_match(left, files, "stem", "suffix", (".tif", ".png", ".jpg")).select("row_no", "match")


NAMES = [
    image_layers, layer_counts, metadata_readiness, metadata_counters, state_summary, dataset_audit, split_findings, milestones, coco_template, merged_metadata, every_nth_val,
    scale_resolution, detection_records, circle_acceptance, backend_summary, truth_comparison, identity_limits, residual_bins, generic_objects, mask_suffixes,
]
QUERIES = {f.__name__: f for f in NAMES}


def _public(lic: str) -> str:
    return f"({_any(lic, t.PUBLIC_HINTS)} AND NOT {_any(lic, t.BLOCKED_HINTS)})"


SRC = "src AS (SELECT * FROM sources WHERE coalesce(source_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY row_no DESC) = 1)"
STATUS = f"""CASE WHEN trim(l, ' ') = '' THEN 'missing' WHEN NOT {_any('lower(l)', t.LICENCE_DENIED)} AND NOT regexp_matches(lower(l), 'cc[-_\\s]?by[-_\\s]?(nc|nd)') AND {_any('lower(l)', t.LICENCE_PATTERNS)} THEN 'accepted' ELSE 'rejected' END"""
LAYERS = f"""{SRC},
j AS (SELECT i.*, s.source_id IS NOT NULL AS known, lower(coalesce(i.license, '')) AS il, lower(coalesce(s.license, '') || ' ' || coalesce(s.license_url, '')) AS sl, lower(trim(coalesce(s.license_status, ''))) AS st,
  lower(coalesce(s.source_type, '') || ' ' || coalesce(i.notes, '')) AS sy, lower(concat_ws(' ', coalesce(i.caption, ''), coalesce(i.notes, ''), coalesce(s.title, ''), coalesce(s.abstract, ''), coalesce(s.keywords, ''))) AS txt,
  s.license AS slic, s.license_url AS surl, s.license_status AS sstat, s.doi AS sdoi, s.title AS stitle FROM images i LEFT JOIN src s ON i.source_id = s.source_id),
k AS (SELECT *, {_public('il')} AS own, known AND (st = 'accepted' OR {_any('sl', t.PUBLIC_HINTS)}) AND NOT {_any('sl', t.BLOCKED_HINTS)} AS sp, contains(sy, 'synthetic') AS syn FROM j),
lay AS (SELECT *, CASE WHEN own OR sp THEN 'public_demo' WHEN syn THEN 'synthetic_core_shell' ELSE 'private_training' END AS training_layer, CASE WHEN syn THEN 'synthetic_core_shell' WHEN own OR sp THEN 'public_demo' ELSE 'private_training' END AS dataset_layer,
  CASE WHEN own OR sp THEN 'public_demo' ELSE 'private_training' END AS distribution_layer, {LAYER_HINTS.format(x='txt')} AS content_layer,
  trim(coalesce(nm_per_px, ''), ' ') <> '' AND lower(trim(coalesce(scale_status, ''), ' ')) IN ('confirmed', 'manual_line', 'manual', 'metadata') AS confirmed_scale FROM k)"""
READY = f"""{SRC}, j AS (SELECT i.*, s.source_id IS NOT NULL AS known, coalesce(s.license, '') || ' ' || coalesce(s.license_url, '') AS l FROM images i LEFT JOIN src s ON i.source_id = s.source_id),
k AS (SELECT *, CASE WHEN known THEN {STATUS} ELSE '' END AS st FROM j),
m AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_blank(c)} THEN '{c}' END" for c in audits.IMAGE_FIELDS)}, CASE WHEN {_blank('caption')} AND {_blank('notes')} THEN 'caption_or_notes' END, CASE WHEN st <> 'accepted' THEN 'accepted_source_license' END], lambda x: x IS NOT NULL) AS miss FROM k),
ready AS (SELECT *, CASE WHEN curation_status = 'accepted' AND scale_status = 'confirmed' AND NOT {_blank('nm_per_px')} AND len(miss) = 0 THEN 'ready' WHEN st IN ('', 'accepted') THEN 'needs_manual_review' ELSE 'blocked' END AS state FROM m)"""
GRP = "coalesce(nullif(trim(lower(source_id), ' '), ''), nullif(trim(image_id, ' '), ''), '')"


def _counts(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n FROM {table}" for n, c in tests.items())


CIRCLES = f"{DET}, v AS (SELECT image_id, seq, cx, cy, radius_px / 4 AS r FROM det), c AS (SELECT * FROM v WHERE pi() * r * r <= 0.25 * 512 * 512 AND cx - r > 0 AND cy - r > 0 AND cx + r < 512 AND cy + r < 512)"
ORACLES = {
    "image_layers": f"WITH {LAYERS} SELECT row_no, training_layer, dataset_layer, distribution_layer, content_layer, confirmed_scale FROM lay",
    "layer_counts": f"WITH {LAYERS} SELECT content_layer || ' / ' || distribution_layer AS layer, count(*) AS images FROM lay GROUP BY 1",
    "metadata_readiness": f"WITH {READY} SELECT row_no, array_to_string(miss, ',') AS missing, state AS metadata_status FROM ready",
    "metadata_counters": f"""WITH {READY}, z AS (SELECT *, {STATUS} AS st FROM (SELECT *, coalesce(license, '') || ' ' || coalesce(license_url, '') AS l FROM sources)) """ + _counts("ready", {
        "images": "true", "images_missing_caption": f"{_blank('caption')} AND {_blank('notes')}", "images_missing_scale": _blank("nm_per_px"), "images_missing_checksum": _blank("file_sha256"), "metadata_ready_images": "state = 'ready'"})
        + " UNION ALL " + _counts("z", {"sources": "true", "publication_ready_sources": "st = 'accepted'", "license_blocked_sources": "st = 'rejected'"}),
    "state_summary": _counts("sources", {"sources": "true", "accepted_sources": "decision = 'accepted'", "ready_sources": "license_status = 'accepted'"}) + " UNION ALL "
        + _counts("images", {"images": "true", **{f"{v}_images": f"curation_status = '{v}'" for v in ("accepted", "rejected", "needs_review")}, "calibrated": f"NOT {_blank('nm_per_px')}", "ready_images": "metadata_status = 'ready'"}) + " UNION ALL "
        + _counts("figure_triage", {"triage_rows": "true", **{f"triage_{v}": f"classification = '{v}'" for v in ("tem", "graph", "abstract_or_scheme", "mixed_figure", "needs_review")}, "triage_tiles": f"NOT {_blank('tile_path')}"}),
    "dataset_audit": f"""WITH {LAYERS}, r AS (SELECT *, coalesce(split, '') AS s, {GRP} AS g FROM lay)
      SELECT 'split' AS kind, s AS name, count(*) AS n FROM r GROUP BY s UNION ALL SELECT 'layer', dataset_layer, count(*) FROM r GROUP BY dataset_layer
      UNION ALL SELECT 'gap', 'missing_calibration', count(*) FROM r WHERE {_blank('nm_per_px')} HAVING count(*) > 0 UNION ALL SELECT 'gap', 'missing_license', count(*) FROM r WHERE {_blank('license')} AND {_blank('sstat')} HAVING count(*) > 0
      UNION ALL SELECT 'gap', 'missing_source', count(*) FROM r WHERE {_blank('source_url')} AND {_blank('sdoi')} HAVING count(*) > 0 UNION ALL SELECT 'gap', 'missing_checksum', count(*) FROM r WHERE {_blank('file_sha256')} HAVING count(*) > 0
      UNION ALL SELECT 'error', 'groups_in_several_splits', count(*) FROM (SELECT g FROM r GROUP BY g HAVING count(DISTINCT s) > 1)""",
    "split_findings": f"""WITH {LAYERS}, r AS (SELECT *, coalesce(split, '') AS s, {GRP} AS g FROM lay)
      SELECT 'error' AS severity, 'bad_split' AS rule, s AS subject, count(*) AS n FROM r WHERE s NOT IN ('train', 'val', 'test') GROUP BY s
      UNION ALL SELECT 'error', 'group_in_several_splits', g, count(DISTINCT s) FROM r WHERE s <> '' GROUP BY g HAVING count(DISTINCT s) > 1
      UNION ALL SELECT CASE WHEN count(DISTINCT s) > 1 THEN 'error' ELSE 'warning' END, 'duplicate_checksum', file_sha256, count(*) FROM r WHERE NOT {_blank('file_sha256')} GROUP BY file_sha256 HAVING count(*) > 1
      UNION ALL SELECT 'error', 'inexact_test', content_layer, count(*) FROM r WHERE s = 'test' AND content_layer <> 'real_exact' GROUP BY content_layer
      UNION ALL SELECT 'error', 'no_test_split', 'test', 0 FROM r HAVING count(*) FILTER (s = 'test') = 0""",
    "milestones": f"""WITH {LAYERS}, a AS (SELECT count(*) AS i, count(DISTINCT nullif({GRP}, '')) AS s, count(*) FILTER (content_layer = 'real_exact') AS e FROM lay),
      g AS (SELECT * FROM (VALUES (0, 'smoke', 5, 1, 0), (1, 'pilot', 150, 2, 1), (2, 'v0', 300, 3, 1), (3, 'publication', 600, 3, 1)) t(p, name, mi, ms, me)),
      c AS (SELECT p, name, i >= mi AS images_pass, s >= ms AS sources_pass, e >= me AS real_exact_pass FROM g, a), d AS (SELECT *, images_pass AND sources_pass AND real_exact_pass AS passes FROM c)
      SELECT name, images_pass, sources_pass, real_exact_pass, passes, coalesce(p = max(p) FILTER (passes) OVER (), false) AS reached FROM d""",
    "coco_template": f"""WITH {LAYERS}, n AS (SELECT row_no, row_number() OVER (ORDER BY row_no) AS id FROM images)
      SELECT n.id, replace(file_path, '\\', '/') AS file_name, coalesce(TRY_CAST(trim(width, ' ') AS INT), 0) AS width, coalesce(TRY_CAST(trim(height, ' ') AS INT), 0) AS height, image_id, source_id, coalesce(sstat, '') AS license_status,
        CASE WHEN {_blank('split')} THEN 'train' ELSE split END AS split, coalesce(sdoi, '') AS doi, coalesce(stitle, '') AS title, dataset_layer FROM lay JOIN n ON lay.row_no = n.row_no WHERE curation_status = 'accepted'""",
    "merged_metadata": f"""WITH {SRC}, u AS (SELECT * FROM sources WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_no DESC) = 1)
      SELECT i.row_no, {", ".join(f"CASE WHEN s.source_id IS NOT NULL THEN s.{c} ELSE u.{c} END AS {c}" for c in ("title", "journal", "year"))} FROM images i LEFT JOIN src s ON i.source_id = s.source_id LEFT JOIN u ON i.source_url = u.url""",
    "every_nth_val": """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderkey FROM orders)), w AS (SELECT *, CAST(greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS BIGINT) AS want FROM k)
      SELECT o_orderkey, p % greatest(1, n // want) = 0 AND p // greatest(1, n // want) < want AS val FROM w""",
    "scale_resolution": f"""WITH {DET}, b AS (SELECT image_id, cx AS x, cy AS y, radius_px * 2 + 0.25 AS bw, radius_px / 10 AS bh FROM det WHERE class = 'inner' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq % 3 DESC, seq) = 1),
      i AS (SELECT o_orderkey AS image_id, (o_orderkey % 9) * 50.0::DOUBLE AS nm, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 1000 END AS px, o_orderkey % 7 = 0 AS line, o_orderkey % 100 AS a, o_orderkey % 50 AS c FROM orders),
      r AS (SELECT i.*, b.x, b.y, bw, bh, CASE WHEN line THEN 'manual_line' WHEN px > 0 THEN 'manual_override' WHEN bw IS NOT NULL THEN 'candidate' ELSE 'none' END AS method FROM i LEFT JOIN b ON i.image_id = b.image_id),
      s AS (SELECT *, CASE method WHEN 'manual_line' THEN 119.5::DOUBLE WHEN 'manual_override' THEN px WHEN 'candidate' THEN bw END AS width FROM r)
      SELECT image_id, method, round(width, 6) AS width_px, round(nm / width, 6) AS nm_per_px, CAST(CASE method WHEN 'manual_line' THEN greatest(0, a - 8) WHEN 'candidate' THEN floor(x) END AS DOUBLE) AS x, CAST(CASE method WHEN 'manual_line' THEN greatest(0, c + 3 - 8) WHEN 'candidate' THEN floor(y) END AS DOUBLE) AS y,
        CAST(CASE method WHEN 'manual_line' THEN greatest(1, least(512, a + 128) - greatest(0, a - 8)) WHEN 'candidate' THEN round_even(bw, 0) END AS DOUBLE) AS w, CAST(CASE method WHEN 'manual_line' THEN greatest(1, least(400, c + 12) - greatest(0, c - 5)) WHEN 'candidate' THEN greatest(1, round_even(bh, 0)) END AS DOUBLE) AS h FROM s""",
    "detection_records": f"""WITH {DET} SELECT image_id, seq, round(radius_px * 2 * 0.37::DOUBLE, 6) AS diameter, round(radius_px * 1.5::DOUBLE * 0.37::DOUBLE, 6) AS minor_axis, round(sqrt(4 * radius_px * radius_px * 2 / pi()) * 0.37::DOUBLE, 6) AS equivalent_diameter,
      round(radius_px, 6) AS radius_px, round(radius_px * 2 / greatest(radius_px * 1.5::DOUBLE, 1), 4) AS aspect_ratio, round(seq / 7, 4) AS confidence_hint FROM det""",
    "circle_acceptance": f"""WITH RECURSIVE {CIRCLES}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS p FROM c),
      w AS (SELECT image_id, p, [{{'s': seq, 'x': cx, 'y': cy, 'r': r}}] AS kept FROM o WHERE p = 1
        UNION ALL SELECT o.image_id, o.p, CASE WHEN len(list_filter(w.kept, lambda k: sqrt((k.x - o.cx) * (k.x - o.cx) + (k.y - o.cy) * (k.y - o.cy)) < 0.65 * greatest(k.r, o.r, 1))) = 0 THEN list_append(w.kept, {{'s': o.seq, 'x': o.cx, 'y': o.cy, 'r': o.r}}) ELSE w.kept END FROM w JOIN o ON o.image_id = w.image_id AND o.p = w.p + 1),
      l AS (SELECT image_id, kept FROM w QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY p DESC) = 1), x AS (SELECT image_id, unnest(kept) AS k FROM l)
      SELECT image_id, k.s AS seq FROM x""",
    "backend_summary": "SELECT l_returnflag AS backend, count(*) AS images, round(avg(l_discount * 10), 9) AS mean_iou, round(avg(l_tax * 10), 9) AS mean_dice, round(avg(l_quantity), 9) AS mean_seconds FROM lineitem GROUP BY 1",
    "truth_comparison": f"""WITH {DET}, a AS (SELECT image_id, count(*) AS n, round(avg(radius_px * 2), 6) AS m FROM det WHERE class = 'outer' GROUP BY 1), b AS (SELECT image_id, count(*) AS n, round(avg(radius_px * 2) FILTER (seq <> 1), 6) AS m FROM det WHERE class = 'inner' GROUP BY 1)
      SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.n, 0) AS true_particles, coalesce(b.n, 0) AS detected_objects, a.m AS true_mean, b.m AS detected_mean, round(b.m / a.m, 6) AS mean_ratio FROM a FULL JOIN b ON a.image_id = b.image_id""",
    "identity_limits": f"""WITH {VAL}, r AS (SELECT morphology, min(least(ref, mea)) AS lo, max(greatest(ref, mea)) AS hi FROM val WHERE ref IS NOT NULL AND mea IS NOT NULL GROUP BY 1)
      SELECT morphology, round(lo - 0.05 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS low, round(hi + 0.05 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS high FROM r""",
    "residual_bins": f"""WITH {VAL}, f AS (SELECT mode, round((mea - ref) * 1000, 0) AS d FROM val WHERE mea IS NOT NULL AND ref IS NOT NULL), s AS (SELECT mode, greatest(6, least(30, count(*) // 3)) AS bins, min(d) AS lo, max(d) AS hi FROM f GROUP BY 1)
      SELECT f.mode, CAST(least(bins - 1, floor((d - lo) / (hi - lo) * bins)) AS INT) AS bin, count(*) AS n FROM f JOIN s ON f.mode = s.mode GROUP BY 1, 2""",
    "generic_objects": f"""WITH {DET} SELECT image_id, printf('obj_%04d', row_number() OVER (PARTITION BY image_id ORDER BY class, seq)) AS object_id, cx AS center_x, cy AS center_y, CASE WHEN class = 'inner' THEN radius_px * 2 ELSE 0 END AS inner_major_axis, CASE WHEN class = 'outer' THEN radius_px * 2 ELSE 0 END AS outer_major_axis,
      'partial' AS pair_status, 'needs_review' AS review_status, CASE WHEN class = 'inner' THEN 'unpaired_outer' ELSE 'unpaired_inner' END AS flags FROM det""",
    "mask_suffixes": r"""WITH f AS (SELECT lower(regexp_extract(file_path, '([^/\\]*?)(\.[A-Za-z]+)?$', 1)) AS stem, lower(regexp_extract(file_path, '(\.[A-Za-z]+)$', 1)) AS suffix FROM images WHERE file_path IS NOT NULL),
      b AS (SELECT stem, suffix AS m FROM f WHERE suffix IN ('.tif', '.png', '.jpg') QUALIFY row_number() OVER (PARTITION BY stem ORDER BY list_position(['.tif', '.png', '.jpg'], suffix)) = 1)
      SELECT row_no, m AS match FROM images i LEFT JOIN b ON lower(regexp_extract(original_file_name, '([^/\\]*?)(\.[A-Za-z]+)?$', 1)) = b.stem WHERE original_file_name IS NOT NULL""",
}
