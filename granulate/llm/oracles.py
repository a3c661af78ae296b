"""SQL twins of the curation queries for DuckDB: brute force instead of candidate search."""

from __future__ import annotations

from granulate.functions import normalise
from granulate.llm import canonical as c


def vals(rows):
    return ", ".join("("+", ".join(f"'{x}'" for x in r)+")" for r in rows)
ACC = "translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def fig(x):
    return f"array_to_string(list_sort(list_distinct([regexp_replace(replace(v, ',', '.'), '(\\.0)+$', '') FOR v IN regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)*')])), ',')"


def let(x):
    return f"regexp_replace(regexp_replace({x}, '(^|[^a-z])v(?:ersion|er)?[. ]*([0-9])|(gpl|odbl)v([0-9])', '\\1\\3 \\2\\4', 'g'), '[^a-z]', '', 'g')"


def adr(x):
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x}, ' ')), '^(?:[a-z]+://)?(?:www[.])?', ''), '[?#].*$', ''), '(?:/(?:deed(?:[.][a-z_-]+)?|legalcode(?:[.][a-z_-]+)?))?/*$', '')"


NOT = "('', 'na', 'none', 'null', 'nan')"
URL = "regexp_matches(value, '^(https?://)?[a-z0-9-]+([.][a-z0-9-]+)+/')"
BARE_LABEL = "regexp_replace(label, '[_ ](?:for|of|the|to)([_ ])', '\\1', 'g')"
P4_FOUND = f"""WITH terms AS (SELECT ref_id, field_name, {ACC.format(x='label')} AS label, {adr('url')} AS url, {fig("regexp_extract(ref_id, '-([0-9.]+)$', 1)")} AS version FROM licence_terms),
elements AS (SELECT * FROM (VALUES {vals(c.ELEMENTS)}) t("by", nc, sa, nd)),
names AS (SELECT * FROM (VALUES {vals(c.NAMES)}) t(ref_id, letters, own)),
cc AS (SELECT ref_id, field_name, lower(regexp_extract(ref_id, '^CC-(BY[A-Z-]*)-[0-9]', 1)) AS code, version FROM terms WHERE regexp_matches(ref_id, '^CC-BY')),
worded AS (SELECT ref_id, field_name, version, replace(code, '-', '') AS code, "by" || CASE WHEN contains(code, '-nc') THEN nc ELSE '' END || CASE WHEN contains(code, '-sa') THEN sa ELSE '' END || CASE WHEN contains(code, '-nd') THEN nd ELSE '' END AS words FROM cc, elements),
scoped AS (SELECT w.*, s FROM worded w, (VALUES (''), ('international'), ('unported'), ('generic')) z(s)),
spelled AS (SELECT ref_id, field_name, version, unnest(['cc' || code, 'creativecommons' || code, code, 'creativecommons' || words || s, words || s, 'cc' || words || s, words || s || 'cc' || code, 'creativecommons' || words || s || 'cc' || code, words || s || 'license', 'creativecommons' || words || s || 'license']) AS letters, '' AS own FROM scoped
  UNION ALL SELECT ref_id, field_name, {fig('label')}, {let('label')}, '' FROM terms
  UNION ALL SELECT t.ref_id, t.field_name, t.version, n.letters, n.own FROM names n JOIN terms t ON string_split(n.ref_id, '_')[1] = string_split(t.ref_id, '_')[1]
  UNION ALL SELECT ref_id, field_name, {fig('label')}, unnest([{let(BARE_LABEL)}, {let("regexp_replace(" + BARE_LABEL + ", '^([a-z]+)ed[_ ]', '\\1 ')")}]), '' FROM terms WHERE regexp_matches(label, '[_ ](for|of|the|to)[_ ]')),
aliases AS (SELECT DISTINCT ref_id, field_name, letters, figures, CASE WHEN length(letters) >= 9 THEN 2 WHEN field_name = 'license_status' AND length(letters) >= 6 THEN 1 ELSE 0 END AS k
  FROM (SELECT ref_id, field_name, letters, unnest([version, own, array_to_string(list_sort(list_distinct(list_filter(string_split(version || ',' || own, ','), lambda x: x <> ''))), ',')]) AS figures FROM spelled) WHERE letters <> ''),
typed AS (SELECT row_no, field_name, url, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({ACC.format(x='value')}, '[_\\x{{2010}}-\\x{{2015}}\\x{{00a0}}\\s]+', ' ', 'g'), '[.;, ]+$', ''), ' '), '^published under the terms of the (.*?)(?: licen[sc]e)?$', '\\1'), '{c.LEAD_IN}', '') AS value
  FROM (SELECT row_no, 'license' AS field_name, license AS value, {adr('license_url')} AS url FROM sources UNION ALL SELECT row_no, 'license_status', license_status, NULL FROM sources)),
parsed AS (SELECT row_no, field_name, CASE WHEN {URL} THEN '' ELSE {let("coalesce(value, '')")} END AS letters, CASE WHEN {URL} THEN '' ELSE {fig("coalesce(value, '')")} END AS figures,
  CASE WHEN {URL} THEN {adr('value')} WHEN regexp_replace(url, '[^a-z]', '', 'g') IN {NOT} THEN NULL ELSE url END AS url, coalesce(trim(value, ' '), '') AS value FROM typed),
said AS (SELECT row_no, field_name, CASE WHEN letters IN {NOT} AND field_name = 'license' THEN '' ELSE letters END AS letters, figures, url FROM parsed
  WHERE CASE WHEN field_name = 'license' THEN url IS NOT NULL OR letters NOT IN {NOT} OR figures <> '' ELSE value <> '' END),
d AS (SELECT DISTINCT field_name, letters FROM said WHERE letters <> ''),
named AS (SELECT d.field_name, d.letters, a.ref_id, a.figures, levenshtein(d.letters, a.letters) AS d FROM d JOIN aliases a ON a.field_name = d.field_name AND abs(length(a.letters) - length(d.letters)) <= a.k AND levenshtein(d.letters, a.letters) <= a.k),
g AS (SELECT DISTINCT field_name, letters, figures, url FROM said),
m AS (SELECT g.*, n.ref_id, n.d, min(n.d) OVER (PARTITION BY g.field_name, g.letters, g.figures, g.url) AS least FROM g JOIN named n ON g.field_name = n.field_name AND g.letters = n.letters AND (g.figures = n.figures OR g.figures = '')),
cand AS (SELECT field_name, letters, figures, url, list_distinct(list(ref_id)) AS refs FROM m WHERE d = least GROUP BY ALL),
known AS (SELECT DISTINCT field_name, letters FROM named),
byurl AS (SELECT url, min(ref_id) AS ref_id FROM terms WHERE url <> '' GROUP BY url HAVING count(*) = 1),
dec AS (SELECT g.*, CASE WHEN len(refs) = 1 THEN refs[1] WHEN len(refs) > 1 THEN CASE WHEN list_contains(refs, u.ref_id) THEN u.ref_id END WHEN k.letters IS NULL THEN u.ref_id END AS ref_id
  FROM g LEFT JOIN cand c ON g.field_name = c.field_name AND g.letters = c.letters AND g.figures = c.figures AND g.url IS NOT DISTINCT FROM c.url
  LEFT JOIN known k ON g.field_name = k.field_name AND g.letters = k.letters LEFT JOIN byurl u ON g.field_name = 'license' AND g.url = u.url)
SELECT s.row_no, s.field_name, coalesce(d.ref_id, 'unmatched') AS ref_id FROM said s JOIN dec d ON s.field_name = d.field_name AND s.letters = d.letters AND s.figures = d.figures AND s.url IS NOT DISTINCT FROM d.url"""

DOI = "regexp_replace(regexp_extract(lower(url_decode(trim(doi))), '(10\\.[0-9.]+/\\S+)', 1), '[.\\s]+$', '')"
SPLIT = """CASE WHEN regexp_replace(lower(split), '[^a-z]', '', 'g') IN ('train', 'training') THEN 'train' WHEN regexp_replace(lower(split), '[^a-z]', '', 'g') IN ('val', 'valid', 'validation', 'dev') THEN 'val'
  WHEN regexp_replace(lower(split), '[^a-z]', '', 'g') IN ('test', 'testing') THEN 'test' END"""
P3_FOUND = f"""WITH RECURSIVE l AS (SELECT DISTINCT lower(trim(source_id)) AS s, {DOI} AS d FROM sources WHERE trim(source_id) <> '' AND {DOI} <> ''),
e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM l a JOIN l b ON a.d = b.d),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
root AS (SELECT a AS s, min(b) AS root FROM r GROUP BY a),
i AS (SELECT lower(trim(source_id)) AS s, {SPLIT} AS sp FROM images WHERE trim(source_id) <> ''),
g AS (SELECT i.s, sp, coalesce(root, i.s) AS root FROM i LEFT JOIN root ON i.s = root.s)
SELECT DISTINCT s AS source_id FROM g WHERE root IN (SELECT root FROM g GROUP BY root HAVING count(DISTINCT sp) > 1)"""



def digest(x):
    t = f"regexp_replace(regexp_replace(lower({x}), '\\s', '', 'g'), '^(sha-?_?256[:=_-]?|0x)', '')"
    return f"CASE WHEN regexp_matches({t}, '^[0-9a-f]{{64}}$') AND {t} <> repeat({t}[1:1], 64) AND {t} <> '{normalise.EMPTY_SHA256}' THEN {t} END"


def picture(x):
    t = f"lower(regexp_replace({x}, '\\s', '', 'g'))"
    return f"CASE WHEN regexp_matches({t}, '^[0-9a-f]{{64}}$') AND {t} <> repeat({t}[1:1], 64) THEN CAST(unhex({t}) AS BIT) END"


NAME = "lower(regexp_extract(tile_path, '([^/\\\\]*)$', 1))"
PLACE = "regexp_extract(n, '^.+?[ _-]tile((?:[ _-][xy]\\d+)+)', 1)"
P2_FOUND = f"""WITH i AS (SELECT row_no AS k, {SPLIT} AS sp, {digest("file_sha256")} AS d, {picture("ahash")} AS h FROM images),
t AS (SELECT tile_no AS k, {SPLIT} AS sp, {NAME} AS n, TRY_CAST(height AS DOUBLE) AS h, TRY_CAST(width AS DOUBLE) AS w FROM figure_triage),
u AS (SELECT k, sp, h, w, regexp_extract(n, '^(.+?)(?:[ _-]panel[ _-]([a-z0-9]+))?[ _-]tile(?:[ _-][xy]\\d+)+', 1) AS f, regexp_extract(n, '^.+?(?:[ _-]panel[ _-]([a-z0-9]+))?[ _-]tile(?:[ _-][xy]\\d+)+', 1) AS p,
  TRY_CAST(regexp_extract({PLACE}, '[ _-]y(\\d+)', 1) AS DOUBLE) AS y, TRY_CAST(regexp_extract({PLACE}, '[ _-]x(\\d+)', 1) AS DOUBLE) AS x FROM t WHERE sp IS NOT NULL),
v AS (SELECT * FROM u WHERE f <> '' AND y IS NOT NULL AND x IS NOT NULL AND h > 0 AND w > 0)
SELECT 'image' AS kind, least(a.k, b.k) AS key_a, greatest(a.k, b.k) AS key_b FROM i a JOIN i b ON a.sp = 'train' AND b.sp IN ('val', 'test') AND (a.d = b.d OR bit_count(xor(a.h, b.h)) <= 12)
UNION ALL
SELECT 'tile', least(a.k, b.k), greatest(a.k, b.k) FROM v a JOIN v b ON a.f = b.f AND a.p = b.p AND a.sp = 'train' AND b.sp IN ('val', 'test')
WHERE least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x)
  AND 2 * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) >= least(a.h * a.w, b.h * b.w)"""

BARE = "regexp_replace(regexp_replace(trim(source_url, ' '), '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '')"
RESOURCE = f"""CASE WHEN trim(source_url, ' ') <> '' THEN regexp_replace(regexp_replace(lower(regexp_extract({BARE}, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
  || regexp_replace(url_decode(regexp_extract({BARE}, '^[^/?]*([^?]*)', 1)), '/+$', '') || '?'
  || array_to_string(list_sort(list_filter(string_split(regexp_extract({BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|sessionid)(=|$)'))), '&') END"""
FIELDS = f"""{digest("file_sha256")} AS d, {picture("ahash")} AS h, nullif(lower(trim(image_id)), '') AS i, {RESOURCE} AS u"""
P6_FOUND = f"""WITH n AS (SELECT batch_no AS b, record_no AS r, {FIELDS} FROM image_batches),
o AS (SELECT -1 AS b, row_no AS r, {FIELDS} FROM images WHERE lower(trim(curation_status)) = 'accepted' UNION ALL SELECT * FROM n)
SELECT DISTINCT n.r AS record_no FROM n JOIN o ON (o.b < n.b OR o.b = n.b AND o.r < n.r) AND (n.d = o.d OR n.i = o.i OR n.u = o.u OR bit_count(xor(n.h, o.h)) <= 12)"""

P4_UNMATCHED = f"""WITH f AS ({P4_FOUND}) SELECT f.field_name, CASE WHEN f.field_name = 'license' THEN s.license ELSE s.license_status END AS value,
  CASE WHEN f.field_name = 'license' THEN s.license_url END AS address, count(*) AS n_rows FROM f JOIN sources s ON f.row_no = s.row_no WHERE f.ref_id = 'unmatched' GROUP BY ALL"""
P2_COUNTS = f"""WITH f AS ({P2_FOUND}), i AS (SELECT row_no AS k, {SPLIT} AS sp, nullif(lower(trim(source_id)), '') AS source, {digest("file_sha256")} AS d, {picture("ahash")} AS h FROM images),
t AS (SELECT tile_no AS k, {SPLIT} AS sp, nullif(lower(trim(source_pdf)), '') AS source, {NAME} AS n, TRY_CAST(height AS DOUBLE) AS h, TRY_CAST(width AS DOUBLE) AS w FROM figure_triage),
u AS (SELECT k, sp, source, h, w, TRY_CAST(regexp_extract({PLACE}, '[ _-]y(\\d+)', 1) AS DOUBLE) AS y, TRY_CAST(regexp_extract({PLACE}, '[ _-]x(\\d+)', 1) AS DOUBLE) AS x FROM t),
p AS (SELECT 'image' AS kind, CASE WHEN a.sp = 'train' THEN b.k ELSE a.k END AS e, CASE WHEN a.sp = 'train' THEN b.sp ELSE a.sp END AS split, CASE WHEN a.sp = 'train' THEN b.source ELSE a.source END AS source,
    CASE WHEN a.d = b.d THEN 1.0::DOUBLE ELSE 1 - bit_count(xor(a.h, b.h)) / 256.0::DOUBLE END AS c FROM f JOIN i a ON f.key_a = a.k JOIN i b ON f.key_b = b.k WHERE kind = 'image'
  UNION ALL SELECT 'tile', CASE WHEN a.sp = 'train' THEN b.k ELSE a.k END, CASE WHEN a.sp = 'train' THEN b.sp ELSE a.sp END, CASE WHEN a.sp = 'train' THEN b.source ELSE a.source END,
    (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.h * a.w, b.h * b.w) FROM f JOIN u a ON f.key_a = a.k JOIN u b ON f.key_b = b.k WHERE kind = 'tile'),
r AS (SELECT kind, split, source, e, count(*) AS n, max(c) AS c FROM p GROUP BY ALL)
SELECT kind, split, source, sum(n) AS pairs, count(*) AS records, round(avg(c), 6) AS mean_coverage FROM r GROUP BY kind, split, source"""

ORACLES = {"p2_counts": P2_COUNTS, "p4_unmatched": P4_UNMATCHED, "p6_found": P6_FOUND, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND}
