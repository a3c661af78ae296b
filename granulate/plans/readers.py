"""Queries of records, typed sources and reports; the documents are built from the tables, then read by the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.functions import text as t
from granulate.operators import agreement, backends, distribution
from granulate.plans import measurement
from granulate.plans.audits import STATUS
from granulate.plans.curation import _any
from granulate.plans.views import VAL, long_val
from granulate.session import read, shared_folder
from granulate.sources import pages, tables

IMG = ["image_id"]


def _articles(spark, d):
    """Article records as JSON, one a source row."""
    s = read(spark, d, "sources")
    files = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string"), F.when((F.col("row_no") + i) % 3 == 0, ".txt").otherwise(".PNG")).alias("name"), F.when((F.col("row_no") + i) % 5 != 0, F.concat(F.lit("https://files.example/"), F.col("row_no").cast("string"), F.lit("/"), i.cast("string"))).alias("download_url")))
    doc = F.struct(
        "title", "doi", F.concat(F.coalesce("year", F.lit("")), F.lit("-01-02")).alias("published_date"), F.col("abstract").alias("description"), F.split("keywords", ";").alias("tags"),
        F.array(F.struct(F.col("publisher").alias("full_name")), F.struct(F.lit("").alias("full_name")), F.struct(F.col("journal").alias("full_name"))).alias("authors"),
        F.struct(F.col("license").alias("name"), F.col("license_url").alias("url")).alias("license"), files.alias("files"),
    )
    return s.select("row_no", F.to_json(doc).alias("json"))


def article_rows(spark, d):
    a = _articles(spark, d).select("row_no", pages.article(F.col("json")).alias("a"))
    return a.select("row_no", *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("title", "doi", "year", "license", "authors", "license_status", "modality")])


def record_pictures(spark, d):
    return _articles(spark, d).select("row_no", F.posexplode(pages.record_files(F.col("json"), 3)).alias("pos", "f")).select("row_no", "pos", F.col("f.name").alias("name"), F.col("f.address").alias("address"))


def typed_sources(spark, d):
    """Sources as typed, with a page, nothing or an error as what was fetched."""
    s = read(spark, d, "sources")
    page = F.concat(F.lit("<html><head><title> "), F.coalesce(F.regexp_replace("title", "[<>]", ""), F.lit("")), F.lit("</title></head><a rel='license' href='https://creativecommons.org/licenses/by"), F.when(F.col("row_no") % 2 == 0, "/noncommercial/'>x</a></html>").otherwise("/4.0/'>x</a></html>"))
    fetched = s.select("row_no", F.concat(F.lit("https://host.example/"), F.col("row_no").cast("string"), F.when(F.col("row_no") % 7 == 0, ".png").otherwise("")).alias("raw"), F.when(F.col("row_no") % 5 != 0, page).alias("content"), F.when(F.col("row_no") % 11 == 0, "timed out").alias("error"))
    return pages.validated(fetched).select("raw", "adapter", "status", "reason", F.coalesce("license_status", F.lit("")).alias("license_status"), F.coalesce("title", F.lit("")).alias("title"))


def seed_listing(spark, d):
    """Sources as two seed lists, the even rows as papers."""
    s = read(spark, d, "sources")
    even = F.col("row_no") % 2 == 0
    paper = F.struct("title", F.col("url").alias("file"), "doi", F.when(F.col("row_no") % 4 == 0, "real_exact").alias("candidate_layer"), "license", "license_status", F.col("journal").alias("training_use"), F.lit("n").alias("notes"))
    other = F.struct(F.col("title").alias("name"), "url", "doi", "license", "license_status", (F.col("row_no") % 3 == 0).alias("redistribution_caution"), F.col("journal").alias("use"))
    docs = s.select(F.to_json(F.struct(F.when(even, F.array(paper)).alias("local_pdf_sources"), F.when(~even, F.array(other)).alias("related_datasets"))).alias("value"))
    return pages.seed_rows(docs)


def undefined_metrics(spark, d):
    """Metrics without a value and why, over all rows and by image."""
    r = agreement.undefined(agreement.report(long_val(spark, d).withColumn("few", F.col("image_id").cast("string")), ["few"], ["diameter"]))
    return r.select("stratum", "value", F.explode("undefined").alias("metric", "reason"))


def report_files(spark, d):
    """The written report read again: the pairs with their verdict, counted."""
    path = shared_folder(spark, "report")
    agreement.write_report(long_val(spark, d), ["morphology", "mode"], ["diameter"], path)
    return tables.csv_any(spark, f"{path}/pairs").groupBy("morphology", "reason").agg(F.count("*").alias("n"))


def frame_warnings(spark, d):
    """Warnings of images by objects and frame; orders give the frames."""
    frames = read(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 40).cast("double").alias("grey_std"), F.when(F.col("o_orderkey") % 3 == 0, "manual_line").when(F.col("o_orderkey") % 3 == 1, "candidate").alias("scale_method"))
    return distribution.image_warnings(measurement._objects(spark, d), IMG, frames).select("image_id", F.array_join("warnings", "|").alias("warnings"))


def manual_backend(spark, d):
    """Detections as they are, through the registry of back-ends."""
    from granulate.plans.views import det

    v = det(spark, d).select("image_id", "seq", "cx", "cy", (F.col("radius_px") * 2).alias("area_px"))
    return backends.predict("manual", v).groupBy("backend", "review_required").agg(F.count("*").alias("n"), F.count("score").alias("scored"))


NAMES = [article_rows, record_pictures, typed_sources, seed_listing, undefined_metrics, report_files, frame_warnings, manual_backend]
QUERIES = {f.__name__: f for f in NAMES}

TXT = "lower(concat_ws(' ', title, abstract))"
ORACLES = {
    "article_rows": f"""WITH b AS (SELECT *, concat_ws(' ', nullif(trim(license, ' '), ''), nullif(trim(license_url, ' '), '')) AS l FROM sources), c AS (SELECT *, {STATUS} AS st, {TXT} AS x FROM b WHERE title IS NOT NULL OR doi IS NOT NULL)
      SELECT s.row_no, coalesce(c.title, '') AS title, coalesce(c.doi, '') AS doi, CASE WHEN c.row_no IS NULL THEN '' ELSE (coalesce(c.year, '') || '-01-02')[1:4] END AS year, coalesce(l, '') AS license,
        CASE WHEN c.row_no IS NULL THEN '' ELSE concat_ws('; ', nullif(trim(c.publisher, ' '), ''), nullif(trim(c.journal, ' '), '')) END AS authors, coalesce(st, '') AS license_status,
        CASE WHEN c.row_no IS NULL THEN '' WHEN contains(x, 'haadf') THEN 'HAADF' WHEN contains(x, 'bf-tem') OR contains(x, 'bright-field tem') THEN 'BF-TEM' WHEN contains(x, 'stem') THEN 'STEM' WHEN contains(x, 'tem') OR contains(x, 'transmission electron') THEN 'TEM'
          WHEN contains(x, 'sem') OR contains(x, 'scanning electron') THEN 'SEM' ELSE 'unknown' END AS modality FROM sources s LEFT JOIN c ON s.row_no = c.row_no""",
    "record_pictures": """WITH f AS (SELECT row_no, unnest(range(1, 4)) AS i FROM sources), g AS (SELECT row_no, i, 'f' || i || '.PNG' AS name, 'https://files.example/' || row_no || '/' || i AS address FROM f WHERE (row_no + i) % 3 <> 0 AND (row_no + i) % 5 <> 0)
      SELECT row_no, CAST(row_number() OVER (PARTITION BY row_no ORDER BY i) - 1 AS INT) AS pos, name, address FROM g""",
    "typed_sources": """WITH b AS (SELECT row_no AS n, 'https://host.example/' || row_no || CASE WHEN row_no % 7 = 0 THEN '.png' ELSE '' END AS raw, trim(regexp_replace(coalesce(title, ''), '[<>]', '', 'g'), ' ') AS ti FROM sources)
      SELECT raw, CASE WHEN n % 7 = 0 THEN 'direct_image' ELSE 'generic_html' END AS adapter, CASE WHEN n % 11 = 0 THEN 'error' ELSE 'done' END AS status,
        CASE WHEN n % 11 = 0 THEN 'timed out' WHEN n % 5 = 0 THEN 'nothing was fetched' WHEN n % 7 = 0 THEN 'a picture has no licence of its own' WHEN n % 2 = 0 THEN 'the licence is not public' ELSE 'public licence found' END AS reason,
        CASE WHEN n % 7 = 0 THEN '' WHEN n % 5 = 0 THEN 'missing' WHEN n % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS license_status, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN '' ELSE ti END AS title FROM b""",
    "seed_listing": """WITH b AS (SELECT *, coalesce(license_status, 'needs_review') AS st, lower(coalesce(license_status, 'needs_review')) AS ls FROM sources)
      SELECT coalesce(title, url) AS dataset, coalesce(url, '') AS url, coalesce(doi, '') AS doi, coalesce(license, '') AS license, st AS license_status, row_no % 4 = 0 AS exact, coalesce(journal, '') AS "use",
        CASE WHEN ls IN ('verified', 'accepted', 'public', 'cc_by', 'cc0') THEN 'approved' WHEN contains(ls, 'reject') OR contains(ls, 'blocked') THEN 'rejected' ELSE 'hold_for_license_review' END AS decision FROM b WHERE row_no % 2 = 0
      UNION ALL SELECT coalesce(title, ''), coalesce(url, ''), coalesce(doi, ''), coalesce(license, ''), CASE WHEN row_no % 3 = 0 THEN 'needs_review' ELSE st END, false, coalesce(journal, ''), CASE WHEN row_no % 3 = 0 THEN 'hold_for_license_review' ELSE 'inspect' END FROM b WHERE row_no % 2 = 1""",
    "undefined_metrics": f"""WITH {VAL}, g AS (SELECT 'few' AS stratum, CAST(image_id AS VARCHAR) AS value, * FROM cls UNION ALL SELECT 'overall', 'all', * FROM cls),
      a AS (SELECT stratum, value, count(*) FILTER (reason = 'matched') AS n, var_pop(ref) FILTER (reason = 'matched') AS rv, var_pop(mea) FILTER (reason = 'matched') AS mv FROM g GROUP BY 1, 2)
      SELECT stratum, value, m AS metric, 'fewer than two pairs' AS reason FROM a, (VALUES ('mean_relative_error'), ('r_squared_identity'), ('pearson_r'), ('mae_percent'), ('bias_percent')) t(m) WHERE n < 2
      UNION ALL SELECT stratum, value, 'r_squared_identity', 'the reference values do not vary' FROM a WHERE n >= 2 AND rv = 0 UNION ALL SELECT stratum, value, 'pearson_r', 'one of the series does not vary' FROM a WHERE n >= 2 AND (rv = 0 OR mv = 0)""",
    "report_files": f"WITH {VAL} SELECT morphology, reason, count(*) AS n FROM cls WHERE reason IS NOT NULL GROUP BY 1, 2",
    "frame_warnings": measurement.OBJECTS + """, w AS (SELECT image_id, avg(CAST(list_contains(flags, 'edge') AS INT)) AS e, avg(CAST(pair_status = 'partial' AS INT)) AS u FROM objects GROUP BY 1)
      SELECT o_orderkey AS image_id, concat_ws('|', CASE WHEN o_orderkey % 40 < 18 THEN 'Low contrast' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'Scale was auto-detected; manual scale is recommended' END, CASE WHEN e > 0.25 THEN 'Too many edge objects' END, CASE WHEN u > 0.35 THEN 'Many unpaired objects' END) AS warnings
      FROM orders LEFT JOIN w ON o_orderkey = image_id""",
    "manual_backend": "SELECT 'manual' AS backend, false AS review_required, count(*) AS n, 0 AS scored FROM lineitem",
}
