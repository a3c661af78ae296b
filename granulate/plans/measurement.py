"""Queries of the measurement family: agreement, distributions, pairing, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.functions import geometry as g
from granulate.operators import agreement, distribution, pairing
from granulate.plans.views import DET, OUTLINE, VAL, det, long_val, outline, val
from granulate.session import read

IMG = ["image_id"]
METRICS = """
  CASE WHEN n >= 2 THEN n ELSE 0 END AS n,
  CASE WHEN n >= 2 THEN round(rm, 6) END AS reference_mean, CASE WHEN n >= 2 THEN round(mm, 6) END AS measured_mean,
  CASE WHEN n >= 2 THEN round(mae_, 6) END AS mae, CASE WHEN n >= 2 THEN round(100 * mae_ / nullif(rm, 0), 6) END AS mae_percent,
  CASE WHEN n >= 2 THEN round(sqrt(msq), 6) END AS rmse, CASE WHEN n >= 2 THEN round(bias, 6) END AS mean_bias,
  CASE WHEN n >= 2 THEN round(100 * bias / nullif(rm, 0), 6) END AS bias_percent,
  CASE WHEN n >= 2 AND rmin > 0 THEN round(rel, 6) END AS mean_relative_error,
  CASE WHEN n >= 2 AND rvar * n > 0 THEN round(1 - ssr / (rvar * n), 6) END AS r_squared_identity,
  CASE WHEN n >= 2 AND rvar > 0 AND mvar > 0 THEN round(pr, 6) END AS pearson_r,
  CASE WHEN n >= 2 THEN round(bias - 1.96 * coalesce(sd, 0), 6) END AS limit_low, CASE WHEN n >= 2 THEN round(bias + 1.96 * coalesce(sd, 0), 6) END AS limit_high,
  refs AS reference_particles, meas AS measured_particles, n AS matched_particles, refs - n AS missed, meas - n AS extra, flagged,
  round(n / nullif(refs, 0), 6) AS recall, round(n / nullif(meas, 0), 6) AS precision, round(meas / nullif(refs, 0), 6) AS count_ratio,
  CASE WHEN n >= 2 THEN 100 * mae_ / rm <= 10 AND abs(100 * bias / rm) <= 5 END AS target_pass"""
AGGREGATES = """
  count(*) FILTER (reason = 'matched') AS n, avg(ref) FILTER (reason = 'matched') AS rm, avg(mea) FILTER (reason = 'matched') AS mm,
  avg(abs(mea - ref)) FILTER (reason = 'matched') AS mae_, avg((mea - ref) * (mea - ref)) FILTER (reason = 'matched') AS msq,
  avg(mea - ref) FILTER (reason = 'matched') AS bias, min(ref) FILTER (reason = 'matched') AS rmin,
  avg(abs(mea - ref) / ref) FILTER (reason = 'matched') AS rel, var_pop(ref) FILTER (reason = 'matched') AS rvar,
  var_pop(mea) FILTER (reason = 'matched') AS mvar, sum((mea - ref) * (mea - ref)) FILTER (reason = 'matched') AS ssr,
  corr(ref, mea) FILTER (reason = 'matched') AS pr, stddev_samp(mea - ref) FILTER (reason = 'matched') AS sd,
  count(ref) AS refs, count(mea) AS meas, count(*) FILTER (reason LIKE 'flagged%') AS flagged"""
PAIRS = """
n_o AS (SELECT image_id, seq AS s, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS k, cx, cy, radius_px FROM det WHERE class = '{first}'),
n_i AS (SELECT image_id, list({{'s': seq, 'x': cx, 'y': cy}} ORDER BY seq) AS rows FROM det WHERE class = '{second}' GROUP BY image_id),
step AS (
  SELECT image_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS d, CAST([] AS BIGINT[]) AS used FROM n_i
  UNION ALL
  SELECT image_id, k, a, m.s, m.d, CASE WHEN m IS NULL THEN used ELSE list_append(used, m.s) END FROM (
    SELECT o.image_id, o.k, o.s AS a, t.used,
           list_sort([{{'d': sqrt((r.x - o.cx) * (r.x - o.cx) + (r.y - o.cy) * (r.y - o.cy)), 's': r.s}} FOR r IN i.rows
             IF NOT list_contains(t.used, r.s) AND sqrt((r.x - o.cx) * (r.x - o.cx) + (r.y - o.cy) * (r.y - o.cy)) <= {reach}])[1] AS m
    FROM step t JOIN n_o o ON o.image_id = t.image_id AND o.k = t.k + 1 JOIN n_i i ON i.image_id = t.image_id))
"""


def validation_agreement(spark, d):
    """Flagship: all agreement metrics, overall and by stratum."""
    return agreement.report(long_val(spark, d), ["morphology", "mode"], ["diameter"])


def validation_unmatched(spark, d):
    return agreement.reasons(long_val(spark, d), ["morphology"])


def validation_merge(spark, d):
    v = val(spark, d)
    ref = v.where("particle_id <= 5").select("image_id", "particle_id", F.col("reference_diameter").alias("diameter"), F.col("part").alias("o"), "morphology")
    mea = v.where("particle_id >= 3").select("image_id", "particle_id", F.col("measured_diameter").alias("diameter"), F.col("part").alias("o"), "morphology")
    # Repeated keys: the row of the largest part, then of the largest value, is the last one.
    ref, mea = (t.withColumn("o", F.struct("o", "diameter", "morphology")) for t in (ref, mea))
    return agreement.merge_tables(ref, mea, ["image_id", "particle_id"], "o", ["morphology"]).select(
        "image_id", "particle_id", "morphology", F.round("reference_diameter", 9).alias("reference_diameter"), F.round("measured_diameter", 9).alias("measured_diameter")
    )


def bland_altman_points(spark, d):
    p = agreement.bland_altman_points(long_val(spark, d), ["image_id", "particle_id", "part"])
    return p.select("image_id", "particle_id", "part", F.round("pair_mean", 9).alias("pair_mean"), F.round("difference", 9).alias("difference"))


def error_points(spark, d):
    p = agreement.error_points(long_val(spark, d), ["image_id", "particle_id", "part"])
    return p.select("image_id", "particle_id", "part", F.round("ref", 9).alias("ref"), F.round("abs_error", 9).alias("abs_error"))


def class_summary(spark, d):
    return distribution.class_summary(det(spark, d).withColumn("diameter", F.col("radius_px") * 2), ["class"])


def normality_by_class(spark, d):
    return distribution.distribution(read(spark, d, "events"), ["event_type"], "value")


def histogram_fixed(spark, d):
    return distribution.histogram(read(spark, d, "events"), ["event_type"], "value", 10.0)


def histogram_auto(spark, d):
    return distribution.histogram(read(spark, d, "events"), ["event_type"], "value")


def gaussian_curve(spark, d):
    return distribution.gaussian_curve(read(spark, d, "events"), ["event_type"], "value")


def _sides(spark, d):
    v = det(spark, d)
    return v.where("class = 'outer'").drop("class"), v.where("class = 'inner'").drop("class")


def pair_outer(spark, d):
    o, i = _sides(spark, d)
    return pairing.pair_outer(o, i, IMG).withColumn("d", F.round("d", 6))


def pair_inner(spark, d):
    o, i = _sides(spark, d)
    return pairing.pair_inner(i, o, IMG).withColumn("d", F.round("d", 6))


def pair_any(spark, d):
    o, i = _sides(spark, d)
    return pairing.pair_any(o, i, IMG).withColumn("d", F.round("d", 6))


def nearest_click(spark, d):
    o, i = _sides(spark, d)
    return pairing.nearest(o, i, IMG, F.lit(100.0)).withColumn("d", F.round("d", 6))


def contained_decorations(spark, d):
    o, i = _sides(spark, d)
    return pairing.contained(o, i, IMG).select("image_id", "a", "b", F.round("d", 6).alias("d"))


def unassigned_decorations(spark, d):
    o, i = _sides(spark, d)
    inside = pairing.contained(o, i, IMG).select("image_id", F.col("b").alias("seq")).distinct()
    return i.join(inside, ["image_id", "seq"], "left_anti").select("image_id", "seq", "cx", "cy")


def _carriers(spark, d):
    o, i = _sides(spark, d)
    inside = pairing.contained(o, i, IMG).groupBy("image_id", "a").agg(F.count("*").alias("c"), F.avg(F.col("b_radius_px") * 2).alias("m"))
    c = o.join(inside.withColumnRenamed("a", "seq"), ["image_id", "seq"], "left")
    n = F.coalesce("c", F.lit(0))
    return c.select("image_id", "seq", (F.col("radius_px") * 2).alias("outer_major_axis"), n.alias("decoration_count"),
                    g.decoration_density(n, F.col("radius_px") * 2, F.col("radius_px") * 1.5).alias("density"), F.coalesce("m", F.lit(0.0)).alias("mean_decoration"))


def decorated_metrics(spark, d):
    return distribution.decorated_summary(_carriers(spark, d).withColumn("part", F.col("image_id") % 10), ["part"])


def nms_dedupe(spark, d):
    v = det(spark, d)
    return pairing.deduplicate(v.drop("class"), IMG).select("image_id", "seq")


def _objects(spark, d):
    o, i = _sides(spark, d)
    pairs = pairing.pair_outer(o, i, IMG).select("image_id", "a", "b")
    half = lambda t, p: t.select("image_id", F.col("seq").alias(p), F.struct("cx", "cy", (F.col("radius_px") * 2).alias("major"), (F.col("radius_px") * 2).alias("minor"), (F.col("radius_px") * 2).alias("equivalent"), F.when(g.touches_edge(F.col("cx") - F.col("radius_px"), F.col("cy") - F.col("radius_px"), F.col("radius_px") * 2, F.col("radius_px") * 2, F.lit(900), F.lit(900)), F.array(F.lit("edge"))).otherwise(F.array().cast("array<string>")).alias("flags")).alias("s" + p))
    left = half(o, "a").join(pairs, ["image_id", "a"], "left").join(half(i, "b"), ["image_id", "b"], "left")
    rest = half(i, "b").join(pairs, ["image_id", "b"], "left_anti")
    objects = left.select("image_id", F.struct(F.lit(0).alias("r"), "a").alias("place"), F.col("sb").alias("inner"), F.col("sa").alias("outer")).unionByName(
        rest.select("image_id", F.struct(F.lit(1).alias("r"), F.col("b").alias("a")).alias("place"), F.col("sb").alias("inner"), F.lit(None).cast(left.schema["sa"].dataType).alias("outer"))
    )
    return pairing.assemble(objects.withColumn("flags", F.array().cast("array<string>")), IMG, "spheres")


def object_rows(spark, d):
    r = _objects(spark, d)
    return r.select("image_id", "object_id", "center_x", "center_y", "inner_major_axis", "outer_major_axis", "shell_thickness", F.round("inner_outer_ratio", 6).alias("inner_outer_ratio"),
                    "pair_status", "review_status", "confidence_score", F.array_join("flags", "|").alias("flags"))


def object_summary(spark, d):
    return distribution.object_summary(_objects(spark, d).withColumn("part", F.col("image_id") % 10), ["part"])


def image_warnings(spark, d):
    return distribution.image_warnings(_objects(spark, d), IMG).select("image_id", F.array_join("warnings", "|").alias("warnings"))


def scale_candidate_dedupe(spark, d):
    v = det(spark, d).select("image_id", "seq", F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y"), F.col("radius_px").cast("int").alias("w"), (F.col("radius_px") / 8).cast("int").alias("h"))
    v = v.withColumn("confidence", g.scale_bar_confidence(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(512), F.lit(512)))
    return pairing.scale_candidates(v, IMG).select("image_id", "rank", "x", "y", "w", "h")


def ignored_regions(spark, d):
    v = det(spark, d).select("image_id", "seq", "class", (F.col("cx") - F.col("radius_px")).cast("int").alias("x"), (F.col("cy") - F.col("radius_px")).cast("int").alias("y"), (F.col("radius_px") * 2).cast("int").alias("w"), (F.col("radius_px") * 2).cast("int").alias("h"))
    return pairing.outside(v.where("class = 'outer'"), v.where("class = 'inner'"), IMG).select("image_id", "seq")


def filter_chain(spark, d):
    """Acceptance chain of contours: frame, circularity, elongation, shape, radius and area windows."""
    v = det(spark, d).withColumn("major", F.col("radius_px") * 2).withColumn("minor", F.col("radius_px") * 2 / (1 + F.col("seq") % 3 * 0.45))
    v = v.withColumn("area", 3.0 * F.col("major") * F.col("minor") / 4).withColumn("perimeter", F.col("major") * 2 + F.col("minor") * 1.2)
    v = v.withColumn("circ", g.circularity(F.col("area"), F.col("perimeter"))).withColumn("aspect", g.aspect_ratio(F.col("major"), F.col("minor"))).withColumn("shape", g.shape_class(F.col("circ"), F.col("aspect")))
    edge = g.touches_edge(F.col("cx") - F.col("radius_px"), F.col("cy") - F.col("radius_px"), F.col("major"), F.col("major"), F.lit(700), F.lit(700))
    lo, hi = 12.0, 150.0
    ok = v.where("area > 0 and perimeter > 0").where(~edge).where("shape is not null").where(F.col("radius_px").between(lo, hi)).where(
        F.col("area").between(g.PI * lo * lo * g.MIN_AREA_TOLERANCE, g.PI * hi * hi * g.MAX_AREA_TOLERANCE))
    return ok.select("image_id", "seq", "shape", F.round("circ", 6).alias("circularity"), F.round("aspect", 6).alias("aspect"), F.round(g.equivalent_diameter(F.col("area")), 6).alias("equivalent"))


def metrology_scalars(spark, d):
    """Shell, ratio, outlier flag and density of consecutive detections."""
    from pyspark.sql import Window

    v = det(spark, d).withColumn("core", F.lead("radius_px").over(Window.partitionBy("image_id").orderBy("seq")))
    o, c = F.col("radius_px"), F.col("core")
    ratio = g.core_outer_ratio(F.coalesce(c, F.lit(0.0)), o)
    return v.select("image_id", "seq", g.shell_thickness(o, c).alias("shell"), F.round(ratio, 6).alias("ratio"), g.ratio_outlier(ratio).alias("outlier"),
                    F.round(g.decoration_density(F.col("seq"), o * 2, o), 6).alias("density"), F.round(g.nm_per_pixel(F.lit(100.0), F.col("cx")), 6).alias("nm_per_px"))


def polygon_metrics(spark, d):
    p = F.col("polygon")
    return outline(spark, d).select("image_id", "seq", F.round(g.polygon_area(p), 6).alias("area"), g.polygon_centroid(p)["x"].alias("x"), g.polygon_centroid(p)["y"].alias("y"),
                                    g.polygon_bbox(p)["w"].alias("w"), g.polygon_bbox(p)["h"].alias("h"), F.round(g.physical_diameter(g.polygon_area(p), F.lit(0.5)), 6).alias("diameter"))


def polygon_normalise(spark, d):
    u = g.polygon_normalise(F.col("polygon"), F.lit(512), F.lit(512))
    return outline(spark, d).select("image_id", "seq", F.posexplode(u).alias("i", "v")).select("image_id", "seq", "i", F.round("v", 6).alias("v"))


NAMES = [
    validation_agreement, validation_unmatched, validation_merge, bland_altman_points, error_points, class_summary, normality_by_class, histogram_fixed,
    histogram_auto, gaussian_curve, pair_outer, pair_inner, pair_any, nearest_click, contained_decorations, unassigned_decorations, decorated_metrics,
    nms_dedupe, object_rows, object_summary, image_warnings, scale_candidate_dedupe, ignored_regions, filter_chain, metrology_scalars, polygon_metrics, polygon_normalise,
]
QUERIES = {f.__name__: f for f in NAMES}

DIST = "sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy))"
BINS = """
s AS (SELECT event_type, count(*) AS c, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd FROM events WHERE value IS NOT NULL GROUP BY event_type),
raw AS (SELECT *, (hi - lo) / 25 AS least, greatest((hi - lo) / 25, least((hi - lo) / 6, CASE WHEN sd > 0 THEN 3.49 * sd * pow(c, -1.0 / 3) ELSE (hi - lo) / 10 END)) AS w0 FROM s),
opt AS (SELECT r.*, f.i, f.f * pow(10, floor(log10(w0))) AS cand FROM raw r, (VALUES (1, 0.5), (2, 1.0), (3, 1.5), (4, 2.0), (5, 2.5), (6, 5.0), (7, 10.0)) f(i, f)),
bw AS (SELECT event_type, c, lo, hi, sd, {width} AS bw FROM opt WHERE cand >= least * 0.9 GROUP BY ALL),
fr AS (SELECT *, floor(lo / bw) * bw AS start, ceil(hi / bw) * bw AS stop FROM bw),
nb AS (SELECT *, greatest(1, CAST(ceil((stop - start) / bw) AS INT)) AS bins FROM fr)"""
AUTO = "greatest(0.1, arg_min(cand, abs(cand - w0) + i * 1e-12))"
HIST = """, cnt AS (SELECT e.event_type, least(bins - 1, greatest(0, CAST(floor((value - start) / bw) AS INT))) AS bin, count(*) AS n FROM events e JOIN nb USING (event_type) WHERE value IS NOT NULL GROUP BY ALL),
  cell AS (SELECT event_type, start, bw, unnest(range(bins)) AS bin FROM nb)
  SELECT cell.event_type, CAST(cell.bin AS INT) AS bin, round(start + cell.bin * bw, 6) AS low, coalesce(n, 0) AS n FROM cell LEFT JOIN cnt ON cell.event_type = cnt.event_type AND cell.bin = cnt.bin"""
PAIRED = "SELECT image_id, a, b, round(d, 6) AS d FROM step WHERE b IS NOT NULL"


def _pairs(first: str, second: str, reach: str) -> str:
    return f"WITH RECURSIVE {DET}, {PAIRS.format(first=first, second=second, reach=reach)} {PAIRED}"


EDGE = "(x <= 2 OR y <= 2 OR x + w >= {side} - 2 OR y + w >= {side} - 2)"
OBJECTS = f"""WITH RECURSIVE {DET}, {PAIRS.format(first='outer', second='inner', reach='greatest(o.radius_px * 0.8, 8)')},
half AS (SELECT image_id, seq, cx, cy, radius_px * 2 AS m, {EDGE.format(side=900)} AS edge FROM (SELECT *, cx - radius_px AS x, cy - radius_px AS y, radius_px * 2 AS w FROM det)),
cls AS (SELECT image_id, seq, class FROM det),
pr AS (SELECT image_id, a, b FROM step WHERE b IS NOT NULL),
obj AS (
  SELECT o.image_id, 0 AS r, o.seq AS place, o.cx, o.cy, coalesce(i.m, 0) AS im, o.m AS om, i.seq IS NOT NULL AS paired, false AS no_outer, coalesce(i.edge, false) OR o.edge AS edge
  FROM half o JOIN cls c ON c.image_id = o.image_id AND c.seq = o.seq AND c.class = 'outer' LEFT JOIN pr ON pr.image_id = o.image_id AND pr.a = o.seq LEFT JOIN half i ON i.image_id = pr.image_id AND i.seq = pr.b
  UNION ALL
  SELECT i.image_id, 1, i.seq, i.cx, i.cy, i.m, 0, false, true, i.edge FROM half i JOIN cls c ON c.image_id = i.image_id AND c.seq = i.seq AND c.class = 'inner'
  WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image_id = i.image_id AND pr.b = i.seq)),
o2 AS (SELECT *, CASE WHEN paired THEN im / om ELSE 0 END AS ratio, CASE WHEN paired AND om >= im THEN (om - im) / 2 ELSE 0 END AS shell FROM obj),
o3 AS (SELECT *, paired AND (ratio < 0.25 OR ratio > 0.85) AS outlier FROM o2),
o4 AS (SELECT *, greatest(0, round(1 - CASE WHEN paired THEN 0 ELSE 0.3 END - CASE WHEN edge THEN 0.2 ELSE 0 END - CASE WHEN outlier THEN 0.2 ELSE 0 END, 3)) AS conf FROM o3),
o5 AS (SELECT *, list_filter([CASE WHEN edge THEN 'edge' END, CASE WHEN conf < 0.7 THEN 'low_confidence' END, CASE WHEN outlier THEN 'ratio_outlier' END,
         CASE WHEN NOT paired AND NOT no_outer THEN 'unpaired_inner' END, CASE WHEN no_outer THEN 'unpaired_outer' END], lambda x: x IS NOT NULL) AS flags FROM o4),
objects AS (SELECT image_id, printf('obj_%04d', row_number() OVER (PARTITION BY image_id ORDER BY r, place)) AS object_id, cx AS center_x, cy AS center_y, im AS inner_major_axis, om AS outer_major_axis,
  shell AS shell_thickness, ratio AS inner_outer_ratio, CASE WHEN paired THEN 'paired' ELSE 'partial' END AS pair_status,
  CASE WHEN conf >= 0.7 AND len(flags) = 0 THEN 'ready' ELSE 'needs_review' END AS review_status, conf AS confidence_score, flags FROM o5)
"""
ORACLES = {
    "validation_agreement": f"""WITH {VAL}, spread AS (
        SELECT ref, mea, reason, 'overall' AS stratum, 'all' AS value FROM cls UNION ALL SELECT ref, mea, reason, 'morphology', morphology FROM cls UNION ALL SELECT ref, mea, reason, 'mode', mode FROM cls),
      agg AS (SELECT stratum, value, 'diameter' AS quantity, {AGGREGATES} FROM spread GROUP BY stratum, value),
      k AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS kk FROM agg)
      SELECT stratum, value, quantity, {METRICS} FROM k WHERE stratum = 'overall' OR kk >= 2""",
    "validation_unmatched": f"WITH {VAL} SELECT morphology, reason, count(*) AS n_rows FROM cls WHERE reason <> 'matched' GROUP BY ALL",
    "validation_merge": f"""WITH {VAL}, r AS (SELECT image_id, particle_id, max({{'o': part, 'v': ref, 'm': morphology}}) AS x FROM val WHERE particle_id <= 5 GROUP BY ALL),
      m AS (SELECT image_id, particle_id, max({{'o': part, 'v': mea, 'm': morphology}}) AS x FROM val WHERE particle_id >= 3 GROUP BY ALL)
      SELECT CAST(coalesce(r.image_id, m.image_id) AS VARCHAR) AS image_id, CAST(coalesce(r.particle_id, m.particle_id) AS VARCHAR) AS particle_id, CASE WHEN r.image_id IS NOT NULL THEN r.x.m ELSE m.x.m END AS morphology,
             round(r.x.v, 9) AS reference_diameter, round(m.x.v, 9) AS measured_diameter
      FROM r FULL JOIN m ON r.image_id = m.image_id AND r.particle_id = m.particle_id""",
    "bland_altman_points": f"WITH {VAL} SELECT image_id, particle_id, part, round((ref + mea) / 2, 9) AS pair_mean, round(mea - ref, 9) AS difference FROM cls WHERE reason = 'matched'",
    "error_points": f"WITH {VAL} SELECT image_id, particle_id, part, round(ref, 9) AS ref, round(abs(mea - ref), 9) AS abs_error FROM cls WHERE reason = 'matched'",
    "class_summary": f"WITH {DET} SELECT class, count(*) AS n, round(avg(radius_px * 2), 6) AS mean_diameter, min(radius_px * 2) AS min_diameter, max(radius_px * 2) AS max_diameter FROM det GROUP BY class",
    "normality_by_class": """WITH v AS (SELECT event_type, value AS v FROM events WHERE value > 0), m AS (SELECT event_type, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM v GROUP BY event_type),
      z AS (SELECT event_type, avg(pow((v - m) / nullif(sd, 0), 3)) AS s, avg(pow((v - m) / nullif(sd, 0), 4)) - 3 AS k FROM v JOIN m USING (event_type) GROUP BY event_type),
      a AS (SELECT DISTINCT event_type FROM events)
      SELECT a.event_type, coalesce(n, 0) AS n, round(m, 6) AS mean, round(sd, 6) AS std, CASE WHEN n >= 8 AND sd > 1e-9 THEN round(s, 6) END AS skewness, CASE WHEN n >= 8 AND sd > 1e-9 THEN round(k, 6) END AS kurtosis_excess,
        CASE WHEN coalesce(n, 0) = 0 THEN 'no data' WHEN n < 8 OR sd <= 1e-9 THEN 'insufficient_n' WHEN abs(s) < 1 AND abs(k) < 2 THEN 'roughly_normal' ELSE 'check_distribution' END AS hint
      FROM a LEFT JOIN m USING (event_type) LEFT JOIN z USING (event_type)""",
    "histogram_fixed": f"WITH {BINS.format(width='10.0')}{HIST}",
    "histogram_auto": f"WITH {BINS.format(width=AUTO)}{HIST}",
    "gaussian_curve": f"""WITH {BINS.format(width=AUTO)}, mm AS (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type),
      p AS (SELECT nb.*, m, unnest(range(121)) AS i FROM nb JOIN mm USING (event_type)), q AS (SELECT *, start + i * (stop - start) / 120 AS x FROM p)
      SELECT event_type, CAST(i AS INT) AS i, round(x, 4) AS x, round(c * bw / (sd * 2.5066282746310002) * exp(-0.5 * ((x - m) / sd) * ((x - m) / sd)), 4) AS y FROM q""",
    "pair_outer": _pairs("outer", "inner", "greatest(o.radius_px * 0.8, 8)"),
    "pair_inner": _pairs("inner", "outer", "greatest(o.radius_px * 1.4, 12)"),
    "pair_any": _pairs("outer", "inner", "1e9"),
    "nearest_click": f"""WITH {DET} SELECT image_id, a, m.s AS b, round(m.d, 6) AS d FROM (SELECT a.image_id, a.seq AS a, min({{'d': {DIST}, 's': b.seq}}) AS m
      FROM det a JOIN det b ON a.image_id = b.image_id AND b.class = 'inner' WHERE a.class = 'outer' AND {DIST} <= 100 GROUP BY a.image_id, a.seq)""",
    "contained_decorations": f"WITH {DET} SELECT a.image_id, a.seq AS a, b.seq AS b, round({DIST}, 6) AS d FROM det a JOIN det b ON a.image_id = b.image_id AND a.class = 'outer' AND b.class = 'inner' AND {DIST} <= greatest(a.radius_px, 1) * 1.05",
    "unassigned_decorations": f"WITH {DET} SELECT b.image_id, b.seq, b.cx, b.cy FROM det b WHERE b.class = 'inner' AND NOT EXISTS (SELECT 1 FROM det a WHERE a.image_id = b.image_id AND a.class = 'outer' AND {DIST} <= greatest(a.radius_px, 1) * 1.05)",
    "decorated_metrics": f"""WITH {DET}, i AS (SELECT a.image_id, a.seq, count(*) AS c, avg(b.radius_px * 2) AS m FROM det a JOIN det b ON a.image_id = b.image_id AND b.class = 'inner' AND {DIST} <= greatest(a.radius_px, 1) * 1.05 WHERE a.class = 'outer' GROUP BY ALL),
      c AS (SELECT d.image_id, d.radius_px, coalesce(c, 0) AS c, coalesce(m, 0) AS m, coalesce(c, 0) / (3.141592653589793 * greatest(d.radius_px, 1e-6) * greatest(d.radius_px * 1.5 / 2, 1e-6)) * 1000 AS dens FROM det d LEFT JOIN i USING (image_id, seq) WHERE d.class = 'outer' AND d.radius_px <> 0)
      SELECT image_id % 10 AS part, count(*) AS carriers, sum(c) AS decorations, round(avg(c), 6) AS mean_count, round(avg(dens), 6) AS mean_density, round(coalesce(avg(m) FILTER (m > 0), 0), 6) AS mean_decoration FROM c GROUP BY part""",
    "nms_dedupe": f"""WITH RECURSIVE {DET}, n AS (SELECT image_id, max(seq) AS last FROM det GROUP BY image_id),
      step AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[]) AS kept FROM n
        UNION ALL SELECT t.image_id, t.k + 1, CASE WHEN len([1 FOR q IN t.kept IF sqrt((q.x - d.cx) * (q.x - d.cx) + (q.y - d.cy) * (q.y - d.cy)) < greatest(q.r, d.radius_px, 1) * 0.65]) > 0 THEN t.kept
          ELSE list_append(t.kept, {{'s': d.seq, 'x': d.cx, 'y': d.cy, 'r': d.radius_px}}) END FROM step t JOIN det d ON d.image_id = t.image_id AND d.seq = t.k + 1)
      SELECT image_id, unnest(kept).s AS seq FROM (SELECT s.image_id, s.kept FROM step s JOIN n ON s.image_id = n.image_id AND s.k = n.last)""",
    "object_rows": OBJECTS + "SELECT image_id, object_id, center_x, center_y, inner_major_axis, outer_major_axis, shell_thickness, round(inner_outer_ratio, 6) AS inner_outer_ratio, pair_status, review_status, confidence_score, array_to_string(flags, '|') AS flags FROM objects",
    "object_summary": OBJECTS + """SELECT image_id % 10 AS part, count(*) AS objects, count(*) FILTER (pair_status = 'paired') AS paired, count(*) FILTER (review_status = 'ready') AS ready, count(*) FILTER (review_status <> 'ready') AS needs_review, 0 AS watershed_splits,
      round(coalesce(avg(inner_major_axis) FILTER (inner_major_axis <> 0), 0), 6) AS mean_inner, round(coalesce(avg(outer_major_axis) FILTER (outer_major_axis <> 0), 0), 6) AS mean_outer, round(coalesce(avg(shell_thickness) FILTER (shell_thickness <> 0), 0), 6) AS mean_shell FROM objects GROUP BY part""",
    "image_warnings": OBJECTS + """SELECT image_id, concat_ws('|', CASE WHEN avg(CAST(list_contains(flags, 'edge') AS INT)) > 0.25 THEN 'Too many edge objects' END, CASE WHEN avg(CAST(pair_status = 'partial' AS INT)) > 0.35 THEN 'Many unpaired objects' END) AS warnings FROM objects GROUP BY image_id""",
    "scale_candidate_dedupe": f"""WITH RECURSIVE {DET}, b AS (SELECT image_id, seq, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, CAST(trunc(radius_px) AS INT) AS w, CAST(trunc(radius_px / 8) AS INT) AS h FROM det),
      c AS (SELECT *, round_even(greatest(0, 0.45 * least(1.0, w / greatest(512 * 0.18, 1.0)) + 0.25 * least(1.0, greatest(0.0, y / greatest(512 * 0.85, 1.0))) + 0.2 * least(1.0, greatest(0.0, x / greatest(512 * 0.65, 1.0))) + 0.1 * least(1.0, (w / greatest(h, 1.0)) / 12) - CASE WHEN y >= 502 THEN 0.45 ELSE 0.0 END), 4) AS confidence FROM b),
      r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) AS rank FROM c), n AS (SELECT image_id, max(rank) AS last FROM r GROUP BY image_id),
      step AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(k BIGINT, x INT, y INT, w INT, h INT)[]) AS kept FROM n
        UNION ALL SELECT t.image_id, t.k + 1, CASE WHEN len([1 FOR q IN t.kept IF greatest(0, least(d.x + d.w, q.x + q.w) - greatest(d.x, q.x)) * greatest(0, least(d.y + greatest(1, d.h), q.y + greatest(1, q.h)) - greatest(d.y, q.y)) / greatest(1, d.w * greatest(1, d.h)) > 0.5]) > 0 THEN t.kept
          ELSE list_append(t.kept, {{'k': d.rank, 'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h}}) END FROM step t JOIN r d ON d.image_id = t.image_id AND d.rank = t.k + 1),
      f AS (SELECT image_id, unnest(kept).k AS rank FROM (SELECT s.image_id, s.kept FROM step s JOIN n ON s.image_id = n.image_id AND s.k = n.last))
      SELECT f.image_id, f.rank, x, y, w, h FROM f JOIN r ON f.image_id = r.image_id AND f.rank = r.rank""",
    "ignored_regions": f"""WITH {DET}, b AS (SELECT image_id, seq, class, CAST(trunc(cx - radius_px) AS INT) AS x, CAST(trunc(cy - radius_px) AS INT) AS y, CAST(radius_px * 2 AS INT) AS w FROM det)
      SELECT p.image_id, p.seq FROM b p WHERE p.class = 'outer' AND NOT EXISTS (SELECT 1 FROM b q WHERE q.image_id = p.image_id AND q.class = 'inner'
        AND greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.w, q.y + q.w) - greatest(p.y, q.y)) / greatest(1, p.w * p.w) > 0.2)""",
    "filter_chain": f"""WITH {DET}, v AS (SELECT *, radius_px * 2 AS major, radius_px * 2 / (1 + seq % 3 * 0.45) AS minor FROM det), a AS (SELECT *, 3.0 * major * minor / 4 AS area, major * 2 + minor * 1.2 AS per FROM v),
      c AS (SELECT *, 4 * 3.141592653589793 * area / (per * per) AS circ, major / greatest(minor, 1e-6) AS aspect FROM a),
      s AS (SELECT *, CASE WHEN circ >= 0.55 AND aspect < 1.8 THEN 'round' WHEN circ >= 0.25 AND aspect >= 1.8 THEN 'elongated' END AS shape, cx - radius_px AS x, cy - radius_px AS y, major AS w FROM c)
      SELECT image_id, seq, shape, round(circ, 6) AS circularity, round(aspect, 6) AS aspect, round(sqrt(4 * area / 3.141592653589793), 6) AS equivalent FROM s
      WHERE NOT {EDGE.format(side=700)} AND shape IS NOT NULL AND radius_px BETWEEN 12 AND 150 AND area BETWEEN 3.141592653589793e0 * 144 * 0.65 AND 3.141592653589793e0 * 22500 * 3""",
    "metrology_scalars": f"""WITH {DET}, v AS (SELECT *, lead(radius_px) OVER (PARTITION BY image_id ORDER BY seq) AS core FROM det), r AS (SELECT *, CASE WHEN radius_px <> 0 THEN coalesce(core, 0) / radius_px ELSE 0 END AS ratio FROM v)
      SELECT image_id, seq, CASE WHEN radius_px >= core THEN (radius_px - core) / 2 ELSE 0 END AS shell, round(ratio, 6) AS ratio, ratio < 0.25 OR ratio > 0.85 AS outlier,
        round(seq / (3.141592653589793 * greatest(radius_px, 1e-6) * greatest(radius_px / 2, 1e-6)) * 1000, 6) AS density, CASE WHEN cx > 0 THEN round(100.0 / cx, 6) END AS nm_per_px FROM r""",
    "polygon_metrics": f"""WITH {OUTLINE}, e AS (SELECT image_id, seq, i, polygon[2 * i + 1] AS x, polygon[2 * i + 2] AS y, polygon[2 * ((i + 1) % 4) + 1] AS x2, polygon[2 * ((i + 1) % 4) + 2] AS y2 FROM outl, range(4) t(i)),
      m AS (SELECT image_id, seq, abs(sum(x * y2 - x2 * y)) / 2 AS area, avg(x) AS x, avg(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM e GROUP BY ALL)
      SELECT image_id, seq, round(area, 6) AS area, x, y, w, h, CASE WHEN area > 0 THEN round(2 * sqrt(area * 0.5 * 0.5 / 3.141592653589793), 6) ELSE 0 END AS diameter FROM m""",
    "polygon_normalise": f"WITH {OUTLINE} SELECT image_id, seq, CAST(i AS INT) AS i, round(greatest(0, least(1, polygon[i + 1] / 512)), 6) AS v FROM outl, range(8) t(i)",
}
