"""Queries of the curation family: splits, duplicates, rule-based classes, upserts, audits, figure triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.functions import geometry as g
from granulate.functions import normalise
from granulate.functions import text as t
from granulate.operators import curation, figures, splits
from granulate.session import read


def group_of():
    """Leakage group of an image row: its source, else the image itself."""
    return F.coalesce(t.filled(F.lower("source_id")), t.filled(F.col("image_id"))).alias("grp")


def split_assign(spark, d):
    rows = read(spark, d, "images").select("row_no", group_of())
    return splits.assign(rows, "grp").select("row_no", "grp", "new_split")


def split_preserve(spark, d):
    rows = read(spark, d, "images").select("row_no", "split", group_of())
    return splits.assign(rows, "grp", keep="split").groupBy("new_split").agg(F.count("*").alias("n"))


def split_audit(spark, d):
    rows = read(spark, d, "images").select(normalise.split_name(F.col("split")).alias("split"), group_of()).where("grp is not null and split is not null")
    return splits.torn_groups(rows, "grp", "split")


def val_split_running(spark, d):
    rows = read(spark, d, "images").select(group_of()).where("grp is not null")
    return splits.running_val(rows, "grp")


def duplicate_checksums(spark, d):
    """Digests, however written, of two rows or more."""
    rows = read(spark, d, "images").select(normalise.sha256_digest(F.col("file_sha256")).alias("file_sha256"), normalise.split_name(F.col("split")).alias("split"))
    return splits.duplicate_checksums(rows, "file_sha256", "split")


def average_hashes(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", t.average_hash(F.col("embedding")).alias("hash"))


def near_duplicates(spark, d):
    return splits.near_duplicates(average_hashes(spark, d), "vec_id", "hash")


def near_duplicate_classes(spark, d):
    """The representative of each row in `near_duplicates`; rows with the same one are exact copies."""
    return splits.classes(average_hashes(spark, d), "vec_id", "hash")


def rule_classes(spark, d):
    s = read(spark, d, "sources")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    lic = F.concat(F.coalesce("license", F.lit("")), F.lit(" "), F.coalesce("license_url", F.lit("")))
    return s.select(
        "row_no", t.modality(text).alias("modality_seen"), t.licence_status(F.trim(lic)).alias("licence_seen"),
        t.public_licence(F.col("license_status"), F.col("license"), F.col("license_url")).alias("is_public"),
        t.content_layer(F.lit(""), F.concat_ws(" ", text, F.coalesce("keywords", F.lit("")), F.coalesce("journal", F.lit("")))).alias("layer"),
    )


def address_parts(spark, d):
    s = read(spark, d, "sources")
    u = t.source_address(F.col("url"))
    return s.select("row_no", u.alias("address"), t.domain(u).alias("host"), t.source_adapter(u).alias("adapter"), t.file_name(u).alias("last_part"),
                    t.in_domains(t.domain(u), ["example"]).alias("is_example"))


def stable_ids(spark, d):
    i = read(spark, d, "images")
    name = F.coalesce("original_file_name", F.lit(""))
    return i.select("row_no", t.stable_id("img", F.coalesce("source_url", F.lit(""))).alias("sid"), t.safe_name(name, F.lit("image")).alias("safe"),
                    F.coalesce(t.page_number(name), F.lit(-1)).alias("page"), F.size(t.split_inputs(F.coalesce("notes", F.lit("")))).alias("n_notes"), t.content_sha256(F.encode(name, "utf-8")).alias("sha"))


def metadata_audit(spark, d):
    return curation.audit_images(read(spark, d, "images"))


def provenance_gaps(spark, d):
    return curation.gap_counts(read(spark, d, "images"), ["curation_status"])


def state_tally(spark, d):
    return curation.tally(read(spark, d, "images"), ["curation_status", "quality_status", "scale_status", "metadata_status", "modality"])


def triage_tally(spark, d):
    return curation.tally(read(spark, d, "figure_triage"), ["classification", "review_status", "is_crowded", "is_multipanel"])


def upsert_last(spark, d):
    """Later batches over the images table: the last row of an id wins, blanks overwrite."""
    i = read(spark, d, "images")
    old = curation.last_by(i.where(t.filled(F.col("image_id")).isNotNull()).select("image_id", "caption", "width", "row_no"), ["image_id"], [F.col("row_no")]).drop("row_no")
    new = read(spark, d, "image_batches").select("image_id", "caption", "width", "record_no")
    return curation.upsert(old, new, "image_id", "record_no")


def apply_edits(spark, d):
    """Customers are the objects, all events the edits: users without a customer are added, rejected ones leave."""
    e = read(spark, d, "events")
    objects = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("value"))
    act = F.element_at(F.array(F.lit("reject"), F.lit("update"), F.lit("add")), (F.col("event_id") % 3 + 1).cast("int"))
    edits = e.select(F.col("user_id").alias("k"), "event_id", "value", act.alias("action"))
    return curation.apply_edits(objects, edits, "k", "event_id")


def precedence_lookup(spark, d):
    """Images looked up in the triage manifest by path, else by figure label."""
    i = read(spark, d, "images").select("row_no", "file_path", "source_id")
    s = read(spark, d, "sources").select("row_no", "source_id", "local_path", "title")
    j = curation.lookup(i.withColumnRenamed("file_path", "p"), s, "source_id", "p", "source_id", "local_path", [F.col("row_no")])
    return j.select("row_no", "found", F.col("row.title").alias("title"))


def missing_sources(spark, d):
    i = read(spark, d, "images").select("row_no", t.filled(F.col("source_id")).alias("source_id"))
    return curation.unmatched_left(i, read(spark, d, "sources").select(t.filled(F.col("source_id")).alias("source_id")), ["source_id"]).select("row_no")


def first_seen_ids(spark, d):
    return curation.first_seen_ids(read(spark, d, "figure_triage").where("classification is not null"), "classification", "tile_no")


def capped_per_source(spark, d):
    return curation.capped(read(spark, d, "figure_triage").where("source_pdf is not null"), ["source_pdf"], [F.col("tile_no")], 5).select("source_pdf", "tile_no", "rn")


def triage_accuracy(spark, d):
    f = read(spark, d, "figure_triage")
    lab = t.manual_label(F.coalesce("tile_path", "crop_path", "image_path", F.lit("")), F.col("classification"))
    rows = f.select("page", F.col("classification").alias("predicted"), lab["label"].alias("label"), lab["marker"].alias("marker"))
    return curation.triage_accuracy(rows, ["predicted"])


def triage_classes(spark, d):
    """Class, confidence and next step of each figure from its three scores."""
    f = figures.typed(read(spark, d, "figure_triage")).where("tem_score is not null and graph_score is not null and abstract_score is not null")
    c = figures.top_class(F.col("tem_score"), F.col("graph_score"), F.col("abstract_score"))
    return f.withColumn("c", c).select("tile_no", F.col("c.class").alias("class"), F.round("c.confidence", 9).alias("confidence"), figures.row_status(F.col("c.class"), F.col("c.confidence")).alias("next_step"))


def triage_scores(spark, d):
    """Class scores from picture features (the hash grids of embeddings stand in for features)."""
    e = read(spark, d, "embeddings")
    x = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    names = ["axis", "white", "text", "scale", "color", "texture", "gray", "edge", "dark"]
    f = {n: x(i) for i, n in enumerate(names)} | {"lines": F.floor(x(9) * 10)}
    return e.select("vec_id", *[F.round(c, 6).alias(k) for k, c in figures.scores(f).items()])


def panel_layouts(spark, d):
    f = figures.typed(read(spark, d, "figure_triage")).where("width > 0 and height > 0")
    w, h = F.col("width"), F.col("height")
    return f.select("tile_no", g.panel_layout(w, h, F.lit("x")).alias("layout"), F.coalesce(F.size(g.aspect_panels(w, h)), F.lit(0)).alias("strips"), F.size(g.quarters(w, h)).alias("quarters"))


def tile_grids(spark, d):
    e = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 60 + 300).cast("int").alias("w"), (F.col("l_suppkey") * 7 % 2500 + 400).cast("int").alias("h"))
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(g.tile_grid(F.col("w"), F.col("h"))).alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.*")


def runs_of_days(spark, d):
    """Gaps and islands: runs of at least three event ids of a type above the median-like cut."""
    e = read(spark, d, "events").select((F.col("event_id") % 7).alias("grp"), F.floor(F.col("event_id") / 7).alias("i"), (F.col("value") > 20).alias("hit"))
    return figures.runs(e, ["grp"], "i", "hit", 3)


NAMES = [
    split_assign, split_preserve, split_audit, val_split_running, duplicate_checksums, average_hashes, near_duplicates, near_duplicate_classes, rule_classes, address_parts, stable_ids,
    metadata_audit, provenance_gaps, state_tally, triage_tally, upsert_last, apply_edits, precedence_lookup, missing_sources, first_seen_ids, capped_per_source,
    triage_accuracy, triage_classes, triage_scores, panel_layouts, tile_grids, runs_of_days,
]
QUERIES = {f.__name__: f for f in NAMES}

SPELLED = "regexp_replace(lower(split), '[^a-z]', '', 'g')"
SPLIT = f"CASE WHEN {SPELLED} IN ('train', 'training') THEN 'train' WHEN {SPELLED} IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN {SPELLED} IN ('test', 'testing') THEN 'test' END"
DIGEST = "regexp_replace(regexp_replace(lower(file_sha256), '\\s', '', 'g'), '^(sha-?_?256[:=_-]?|0x)', '')"
RANKED = f"""i AS (SELECT row_no, split, {SPLIT} AS sp, coalesce(nullif(trim(lower(source_id), ' '), ''), nullif(trim(image_id, ' '), '')) AS grp FROM images), g AS (SELECT DISTINCT grp FROM i WHERE grp IS NOT NULL),
r AS (SELECT grp, row_number() OVER (ORDER BY sha1(grp), grp) - 1 AS p, count(*) OVER () AS n FROM g),
c AS (SELECT *, greatest(1, round_even(n * 0.70, 0)) AS a FROM r), s AS (SELECT *, greatest(a + 1, round_even(n * (0.70::DOUBLE + 0.15::DOUBLE), 0)) AS b FROM c),
x AS (SELECT grp, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN p = 0 THEN 'train' ELSE 'val' END WHEN p < a THEN 'train' WHEN p < b THEN 'val' ELSE 'test' END AS assigned FROM s)"""
HASH = "h AS (SELECT vec_id, label, list_aggregate([CASE WHEN v >= list_avg(embedding::DOUBLE[]) THEN '1' ELSE '0' END FOR v IN embedding::DOUBLE[]], 'string_agg', '') AS hash FROM embeddings)"
TXT = "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))"
PUBLIC = "coalesce(license, '') || ' ' || coalesce(license_url, '')"


def _any(x: str, hints) -> str:
    return "(" + " OR ".join(f"contains({x}, '{h}')" for h in hints) + ")"


def _blank(c: str) -> str:
    return f"coalesce({c}, '') = ''"


LAYER_HINTS = f"CASE WHEN {_any('{x}', t.SYNTHETIC_HINTS)} THEN 'synthetic_core_shell' WHEN {_any('{x}', t.CORE_SHELL_HINTS)} THEN 'real_exact' WHEN {_any('{x}', t.NEAR_HINTS)} THEN 'real_near' ELSE 'unknown' END"
FIELDS = ["source_id", "file_path", "source_url", "license", "file_sha256", "width", "height", "modality", "quality_status"]
MISSING = "list_filter([" + ", ".join(f"CASE WHEN {_blank(c)} THEN '{c}' END" for c in FIELDS) + f", CASE WHEN {_blank('caption')} AND {_blank('notes')} THEN 'caption_or_notes' END], lambda x: x IS NOT NULL)"


def _tally(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(nullif(trim({c}, ' '), ''), 'unspecified') AS value, count(*) AS n FROM {table} GROUP BY ALL" for c in columns)


ORACLES = {
    "split_assign": f"WITH {RANKED} SELECT row_no, i.grp, coalesce(assigned, 'train') AS new_split FROM i LEFT JOIN x ON i.grp = x.grp",
    "split_preserve": f"WITH {RANKED} SELECT CASE WHEN split IN ('train', 'val', 'test') THEN split ELSE coalesce(assigned, 'train') END AS new_split, count(*) AS n FROM i LEFT JOIN x ON i.grp = x.grp GROUP BY 1",
    "split_audit": f"WITH {RANKED} SELECT grp, string_agg(DISTINCT sp, ',' ORDER BY sp) AS splits FROM i WHERE grp IS NOT NULL AND sp IS NOT NULL GROUP BY grp HAVING count(DISTINCT sp) > 1",
    "val_split_running": f"""WITH {RANKED}, z AS (SELECT grp, count(*) AS n FROM i WHERE grp IS NOT NULL GROUP BY grp),
      q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM z)
      SELECT grp, n, before < greatest(1, round_even(total * 0.15::DOUBLE, 0)) OR before = 0 AS val FROM q""",
    "duplicate_checksums": f"""WITH x AS (SELECT {DIGEST} AS file_sha256, coalesce({SPLIT}, '') AS sp FROM images)
      SELECT file_sha256, count(*) AS n, string_agg(DISTINCT sp, ',' ORDER BY sp) AS splits, count(DISTINCT sp) > 1 AS leak
      FROM x WHERE regexp_matches(file_sha256, '^[0-9a-f]{{64}}$') AND file_sha256 <> repeat(file_sha256[1:1], 64) AND file_sha256 <> '{normalise.EMPTY_SHA256}' GROUP BY file_sha256 HAVING count(*) >= 2""",
    "average_hashes": f"WITH {HASH} SELECT vec_id, label, hash FROM h",
    "near_duplicate_classes": f"WITH {HASH} SELECT vec_id, min(vec_id) OVER (PARTITION BY hash) AS representative FROM h WHERE length(hash) = 64",
    "near_duplicates": f"WITH {HASH}, r AS (SELECT hash, min(vec_id) AS k FROM h GROUP BY hash) SELECT a.k AS a, b.k AS b, hamming(a.hash, b.hash) AS distance FROM r a JOIN r b ON a.k < b.k AND hamming(a.hash, b.hash) <= 3",
    "rule_classes": f"""WITH s AS (SELECT row_no, lower({TXT}) AS x, lower(concat_ws(' ', {TXT}, coalesce(keywords, ''), coalesce(journal, ''))) AS y, trim({PUBLIC}, ' ') AS lic, lower({PUBLIC}) AS pub, lower(trim(coalesce(license_status, ''), ' ')) AS st FROM sources)
      SELECT row_no, CASE WHEN contains(x, 'haadf') THEN 'HAADF' WHEN contains(x, 'bf-tem') OR contains(x, 'bright-field tem') THEN 'BF-TEM' WHEN contains(x, 'stem') THEN 'STEM'
          WHEN contains(x, 'tem') OR contains(x, 'transmission electron') THEN 'TEM' WHEN contains(x, 'sem') OR contains(x, 'scanning electron') THEN 'SEM' ELSE 'unknown' END AS modality_seen,
        CASE WHEN lic = '' THEN 'missing' WHEN NOT {_any('lower(lic)', t.LICENCE_DENIED)} AND NOT regexp_matches(lower(lic), 'cc[-_\\s]?by[-_\\s]?(nc|nd)') AND {_any('lower(lic)', t.LICENCE_PATTERNS)} THEN 'accepted' ELSE 'rejected' END AS licence_seen,
        (st = 'accepted' OR {_any('pub', t.PUBLIC_HINTS)}) AND NOT {_any('pub', t.BLOCKED_HINTS)} AS is_public,
        CASE WHEN {_any('y', t.SYNTHETIC_HINTS)} THEN 'synthetic_core_shell' WHEN {_any('y', t.CORE_SHELL_HINTS)} THEN 'real_exact' WHEN {_any('y', t.NEAR_HINTS)} THEN 'real_near' ELSE 'unknown' END AS layer FROM s""",
    "address_parts": """WITH s AS (SELECT row_no, trim(url, ' ') AS u FROM sources), a AS (SELECT row_no, CASE WHEN u = '' THEN '' WHEN starts_with(lower(u), 'doi:') THEN 'https://doi.org/' || trim(u[5:], ' ') WHEN regexp_matches(u, '(?i)^10\\.\\d{4,9}/') THEN 'https://doi.org/' || u
          WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'https://' || u ELSE u END AS address FROM s),
      h AS (SELECT row_no, address, replace(lower(regexp_extract(address, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') AS host, lower(regexp_extract(address, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path FROM a)
      SELECT row_no, address, host, CASE WHEN host = 'doi.org' THEN 'doi' WHEN contains(host, 'zenodo.org') THEN 'zenodo' WHEN contains(host, 'figshare.com') THEN 'figshare' WHEN contains(host, 'ncbi.nlm.nih.gov') THEN 'pmc' WHEN contains(host, 'mdpi.com') THEN 'mdpi'
          WHEN regexp_matches(path, '\\.(png|jpg|jpeg|tif|tiff|webp)$') THEN 'direct_image' WHEN address IS NULL THEN 'generic_html' ELSE 'generic_html' END AS adapter,
        regexp_extract(regexp_replace(address, '[?#].*$', ''), '([^/]*)/?$', 1) AS last_part, host = 'example' OR ends_with(host, '.example') AS is_example FROM h""",
    "stable_ids": """WITH i AS (SELECT row_no, coalesce(source_url, '') AS u, coalesce(original_file_name, '') AS f, coalesce(notes, '') AS n FROM images)
      SELECT row_no, 'img_' || sha1(u)[1:12] AS sid, coalesce(nullif(trim(regexp_replace(f, '[^A-Za-z0-9._-]+', '_', 'g'), '_')[1:120], ''), 'image') AS safe,
        coalesce(TRY_CAST(nullif(regexp_extract(f, '^(\\d{3})_', 1), '') AS INT), -1) AS page, CAST(len(list_filter(regexp_split_to_array(n, '[\\n,;]+'), lambda x: trim(x, ' ') <> '')) AS INT) AS n_notes, sha256(f) AS sha FROM i""",
    "metadata_audit": f"SELECT row_no, array_to_string({MISSING}, ',') AS missing, len({MISSING}) AS n_missing FROM images",
    "provenance_gaps": "SELECT curation_status, count(*) AS images, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in {
        "no_caption": f"{_blank('caption')} AND {_blank('notes')}", "no_scale": _blank("nm_per_px"), "no_checksum": _blank("file_sha256"), "no_licence": _blank("license"), "no_source": _blank("source_id")}.items()) + " FROM images GROUP BY curation_status",
    "state_tally": _tally("images", ["curation_status", "quality_status", "scale_status", "metadata_status", "modality"]),
    "triage_tally": _tally("figure_triage", ["classification", "review_status", "is_crowded", "is_multipanel"]),
    "upsert_last": """WITH o AS (SELECT image_id, caption, width FROM images WHERE trim(image_id, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY row_no DESC) = 1),
      n AS (SELECT image_id, caption, width FROM image_batches WHERE trim(image_id, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY record_no DESC) = 1)
      SELECT coalesce(o.image_id, n.image_id) AS image_id, CASE WHEN n.image_id IS NOT NULL THEN n.caption ELSE o.caption END AS caption, CASE WHEN n.image_id IS NOT NULL THEN n.width ELSE o.width END AS width FROM o FULL JOIN n ON o.image_id = n.image_id""",
    "apply_edits": """WITH o AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS v FROM customer), e AS (SELECT user_id AS k, max(event_id) AS id, arg_max(value, event_id) AS v FROM events GROUP BY 1),
      a AS (SELECT *, CASE id % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'update' ELSE 'add' END AS action FROM e)
      SELECT o.k, CASE WHEN action = 'update' THEN a.v ELSE o.v END AS value FROM o LEFT JOIN a ON o.k = a.k WHERE coalesce(action, '') <> 'reject' UNION ALL SELECT k, v FROM a WHERE action = 'add' AND k NOT IN (SELECT k FROM o)""",
    "precedence_lookup": """WITH a AS (SELECT source_id, arg_max(coalesce(title, chr(0)), row_no) AS title FROM sources WHERE trim(source_id, ' ') <> '' GROUP BY 1), b AS (SELECT local_path, arg_max(coalesce(title, chr(0)), row_no) AS title FROM sources WHERE trim(local_path, ' ') <> '' GROUP BY 1)
      SELECT i.row_no, nullif(CASE WHEN a.source_id IS NOT NULL THEN a.title ELSE b.title END, chr(0)) AS title, CASE WHEN a.source_id IS NOT NULL THEN 'first' WHEN b.local_path IS NOT NULL THEN 'second' END AS found FROM images i LEFT JOIN a ON i.source_id = a.source_id LEFT JOIN b ON i.file_path = b.local_path""",
    "missing_sources": "SELECT row_no FROM images i WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE nullif(trim(s.source_id, ' '), '') = nullif(trim(i.source_id, ' '), ''))",
    "first_seen_ids": "SELECT classification, row_number() OVER (ORDER BY min(tile_no), classification) - 1 AS id FROM figure_triage WHERE classification IS NOT NULL GROUP BY classification",
    "capped_per_source": "SELECT source_pdf, tile_no, row_number() OVER (PARTITION BY source_pdf ORDER BY tile_no) AS rn FROM figure_triage WHERE source_pdf IS NOT NULL QUALIFY rn <= 5",
    "triage_accuracy": """WITH n AS (SELECT classification AS p, lower(coalesce(tile_path, crop_path, image_path, '')) AS n FROM figure_triage),
      l AS (SELECT p, CASE WHEN contains(n, 'graf') OR contains(n, 'graph') THEN 'graph' WHEN contains(n, 'abstract') THEN 'abstract_or_scheme' ELSE p END AS l,
        CASE WHEN contains(n, 'graf') OR contains(n, 'graph') THEN 'g' WHEN contains(n, 'abstract') THEN 'a' WHEN contains(n, 'separar') OR contains(n, 'separate') OR contains(n, 'split') THEN 'manual_needs_split' ELSE 'u' END AS m FROM n)
      SELECT p AS predicted, count(*) AS files, count(*) FILTER (p = l) AS correct, round(100.0 * count(*) FILTER (p = l) / count(*), 6) AS accuracy_percent, count(*) FILTER (m = 'manual_needs_split') AS split_needed, count(*) FILTER (p = l AND m <> 'manual_needs_split') AS ready FROM l GROUP BY p""",
    "triage_classes": """WITH s AS (SELECT tile_no, TRY_CAST(trim(tem_score, ' ') AS DOUBLE) AS t, TRY_CAST(trim(graph_score, ' ') AS DOUBLE) AS g, TRY_CAST(trim(abstract_score, ' ') AS DOUBLE) AS a FROM figure_triage),
      c AS (SELECT *, greatest(t, g, a) AS best, list_sort([t, g, a])[2] AS second FROM s WHERE t IS NOT NULL AND g IS NOT NULL AND a IS NOT NULL), f AS (SELECT *, least(1, greatest(0, best * 0.72::DOUBLE + (best - second) * 0.55::DOUBLE)) AS conf FROM c),
      k AS (SELECT *, CASE WHEN conf < 0.48 THEN 'needs_review' WHEN t = best THEN 'tem' WHEN g = best THEN 'graph' ELSE 'abstract_or_scheme' END AS class FROM f)
      SELECT tile_no, class, round(conf, 9) AS confidence, CASE WHEN class = 'tem' AND conf >= 0.55 THEN 'auto_candidate' WHEN class IN ('graph', 'abstract_or_scheme') AND conf >= 0.55 THEN 'auto_rejected' ELSE 'needs_review' END AS next_step FROM k""",
    "triage_scores": """WITH f AS (SELECT vec_id, [abs(v::DOUBLE) FOR v IN embedding] AS x FROM embeddings)
      SELECT vec_id, round(least(1, greatest(0, x[1] * 0.55::DOUBLE + x[2] * 0.25::DOUBLE + x[3] * 0.25::DOUBLE + CASE WHEN floor(x[10] * 10) >= 2 THEN 0.15::DOUBLE ELSE 0 END - x[4] * 0.20::DOUBLE)), 6) AS graph,
        round(least(1, greatest(0, x[5] * 0.65::DOUBLE + (1 - x[6]) * 0.15::DOUBLE + x[3] * 0.15::DOUBLE + x[2] * 0.08::DOUBLE - x[4] * 0.20::DOUBLE)), 6) AS abstract_or_scheme,
        round(least(1, greatest(0, x[7] * 0.34::DOUBLE + x[6] * 0.28::DOUBLE + x[4] * 0.22::DOUBLE + x[8] * 0.18::DOUBLE + (1 - x[1]) * 0.18::DOUBLE - x[5] * 0.22::DOUBLE)), 6) AS tem,
        round(least(1, greatest(0, x[9] * 2.5::DOUBLE + x[8] * 4.0::DOUBLE + greatest(0, x[6] - 0.55::DOUBLE) * 0.9::DOUBLE)), 6) AS crowding FROM f""",
    "panel_layouts": """WITH f AS (SELECT tile_no, TRY_CAST(trim(width, ' ') AS INT) AS w, TRY_CAST(trim(height, ' ') AS INT) AS h FROM figure_triage), r AS (SELECT *, w / greatest(h, 1) AS q FROM f WHERE w > 0 AND h > 0)
      SELECT tile_no, CASE WHEN w > 1400 AND h / w BETWEEN 0.42 AND 0.60 THEN 'left_right_large_figure' WHEN w < 520 AND h > w * 1.8 THEN 'vertical_panel_stack' WHEN q BETWEEN 0.82 AND 1.15 AND least(w, h) > 900 THEN 'two_by_two_grid' ELSE 'fallback_original' END AS layout,
        CASE WHEN q > 2.25 THEN least(4, greatest(2, CAST(round_even(q, 0) AS INT))) WHEN q < 0.44 THEN least(4, greatest(2, CAST(round_even(1 / q, 0) AS INT))) ELSE 0 END AS strips, 4 AS quarters FROM r""",
    "tile_grids": """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 60 + 300 AS INT) AS w, CAST(l_suppkey * 7 % 2500 + 400 AS INT) AS h FROM lineitem),
      p AS (SELECT *, list_distinct(list_append(range(0, greatest(0, w - 1024) + 1, 819), greatest(0, w - 1024))) AS xs, list_distinct(list_append(range(0, greatest(0, h - 1024) + 1, 819), greatest(0, h - 1024))) AS ys FROM e WHERE w >= 1177.6 OR h >= 1177.6),
      q AS (SELECT *, unnest(xs) AS x FROM p), z AS (SELECT *, unnest(ys) AS y FROM q)
      SELECT l_orderkey, l_linenumber, l_partkey, y, x, least(1024, h - y) AS h, least(1024, w - x) AS w FROM z WHERE least(1024, h - y) >= 420 AND least(1024, w - x) >= 420""",
    "runs_of_days": """WITH e AS (SELECT event_id % 7 AS grp, event_id // 7 AS i, value > 20 AS hit FROM events), r AS (SELECT grp, i, i - row_number() OVER (PARTITION BY grp ORDER BY i) AS k FROM e WHERE hit)
      SELECT grp, min(i) AS start, max(i) + 1 AS "end" FROM r GROUP BY grp, k HAVING max(i) + 1 - min(i) >= 3""",
}
