"""Problem 4: freely typed licence values mapped to a reference list, in SQL only.

Partition-based pigeonhole join: a reference wording is cut into k + 1 segments;
a typed value within k edits keeps one of them at its place shifted by at most
k, so equal substrings find all candidates and levenshtein verifies them.
Figures (versions) must agree exactly. What fits none comes from an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from granulate.session import cut

# Official wordings of the licence elements by language, letters only, accents folded.
ELEMENTS = [
    # by, nc, sa, nd
    ("attribution", "noncommercial", "sharealike", "noderivatives"),
    ("attribution", "noncommercial", "sharealike", "noderivs"),
    ("namensnennung", "nichtkommerziell", "weitergabeuntergleichenbedingungen", "keinebearbeitungen"),
    ("namensnennung", "nichtkommerziell", "weitergabeuntergleichenbedingungen", "keinebearbeitung"),
    ("attribution", "pasdutilisationcommerciale", "partagedanslesmemesconditions", "pasdemodification"),
    ("reconocimiento", "nocomercial", "compartirigual", "sinobraderivada"),
    ("atribucion", "nocomercial", "compartirigual", "sinderivadas"),
    ("naamsvermelding", "nietcommercieel", "gelijkdelen", "geenafgeleidewerken"),
    ("attribuzione", "noncommerciale", "condividiallostessomodo", "nonoperederivate"),
]
# Further names of single entries, letters only, with the figures of the name itself.
NAMES = [
    ("CC0-1.0", "cc", "0"), ("CC0-1.0", "ccuniversal", "0"), ("CC0-1.0", "cczero", ""),
    ("CC0-1.0", "creativecommonszero", ""), ("CC0-1.0", "creativecommonszerouniversal", ""),
    ("PDM-1.0", "pdm", ""), ("PDM-1.0", "publicdomainmark", ""), ("PDM-1.0", "ccpublicdomainmark", ""),
    ("MIT", "mit", ""), ("MIT", "mitlicence", ""), ("MIT", "themitlicense", ""), ("MIT", "themitlicence", ""),
    ("MIT", "expatmit", ""), ("MIT", "mitexpat", ""), ("MIT", "expat", ""), ("MIT", "expatlicense", ""),
    ("Apache-2.0", "apache", ""), ("Apache-2.0", "asl", ""), ("Apache-2.0", "apachelicence", ""),
    ("Apache-2.0", "apachesoftwarelicense", ""),
    ("BSD-3-Clause", "bsdclause", "3"), ("BSD-3-Clause", "clausebsd", "3"), ("BSD-3-Clause", "newbsdlicenceclause", "3"),
    ("BSD-3-Clause", "newbsdlicenseclause", "3"), ("BSD-3-Clause", "bsdclauselicence", "3"),
    ("BSD-3-Clause", "clausebsdlicense", "3"), ("BSD-3-Clause", "clausebsdlicence", "3"),
    ("BSD-3-Clause", "newbsdlicense", ""), ("BSD-3-Clause", "newbsdlicence", ""), ("BSD-3-Clause", "newbsd", ""),
    ("GPL-3.0", "gpl", ""), ("GPL-3.0", "gnugpl", ""), ("GPL-3.0", "generalpubliclicense", ""),
    ("GPL-3.0", "generalpubliclicence", ""), ("GPL-3.0", "gnugeneralpubliclicence", ""),
    ("ODbL-1.0", "odbl", ""), ("ODbL-1.0", "opendatabaselicence", ""),
    ("ODC-BY-1.0", "odcby", ""), ("ODC-BY-1.0", "opendatacommonsattribution", ""),
    ("ODC-BY-1.0", "opendatacommonsattributionlicence", ""),
    ("NORRVIK-REUSE-1.2", "norrvikreuselicence", ""), ("NORRVIK-REUSE-1.2", "norrvikpublreuselic", ""),
    ("NORRVIK-REUSE-1.2", "nprlnorrvik", ""), ("NORRVIK-REUSE-1.2", "nprl", ""),
    ("HALDEN-TDM-2", "haldentdm", ""), ("HALDEN-TDM-2", "haldentdmlicence", ""), ("HALDEN-TDM-2", "tdmlicencehalden", ""),
    ("ALL-RIGHTS", "allerechtevorbehalten", ""), ("ALL-RIGHTS", "tousdroitsreserves", ""),
    ("ALL-RIGHTS", "todoslosderechosreservados", ""), ("ALL-RIGHTS", "tuttiidirittiriservati", ""),
    ("ALL-RIGHTS", "allerechtenvoorbehouden", ""),
    ("accepted", "isaccepted", ""), ("accepted", "akzeptiert", ""), ("accepted", "accepte", ""), ("accepted", "aceptado", ""),
    ("missing", "ismissing", ""), ("missing", "fehlt", ""), ("missing", "manquant", ""),
    ("needs_review", "needreview", ""), ("needs_review", "toreview", ""), ("needs_review", "tobereviewed", ""),
    ("rejected", "rejected", ""), ("rejected", "isrejected", ""), ("rejected", "abgelehnt", ""),
    ("verified", "verifiedbycurator", ""), ("verified", "isverified", ""), ("verified", "verifiziert", ""),
]
SAYS_NOTHING = ("", "na", "none", "null", "nan")
LEAD_IN = r"^(?:this work is licen[sc]ed under|distributed under|licen[sc]ed under|(?:\(c\)|©) ?the authors?,?|licen[sc]e ?:)\s*"

FOLD = "translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def _figures(x: str) -> str:
    """Distinct figures of a text without closing .0, sorted and joined."""
    return (
        "array_join(array_sort(array_distinct(transform(regexp_extract_all("
        + x
        + r", '([0-9]+(?:[.,][0-9]+)*)', 1), v -> regexp_replace(replace(v, ',', '.'), '(\\.0)+$', '')))), ',')"
    )


def _letters(x: str) -> str:
    """Letters only; a v or version before a figure is no letter of the name."""
    return f"regexp_replace(regexp_replace({x}, '(?<![a-z])v(?:ersion|er)?[. ]*(?=[0-9])|(?<=gpl|odbl)v(?=[0-9])', ' '), '[^a-z]', '')"


def _address(x: str) -> str:
    """Address without scheme, www., case, query and the page below the licence."""
    return (
        f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^(?:[a-z]+://)?(?:www[.])?', ''), '[?#].*$', ''),"
        " '(?:/(?:deed(?:[.][a-z_-]+)?|legalcode(?:[.][a-z_-]+)?))?/*$', '')"
    )


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM VALUES {text} AS t({names})"


# k by length of the wording: codes of up to eight letters differ by an edit or two among themselves.
EDITS = "CASE WHEN length(letters) >= 9 THEN 2 WHEN field_name = 'license_status' AND length(letters) >= 6 THEN 1 ELSE 0 END"

JOINLESS = "regexp_replace(label, '[_ ](?:for|of|the|to)(?=[_ ])', '')"
ALIASES = f"""
terms AS (
  SELECT ref_id, field_name, {FOLD.format(x="label")} AS label, {_address("url")} AS url,
         {_figures("regexp_extract(ref_id, '-([0-9.]+)$', 1)")} AS version
  FROM {{terms}}),
elements AS ({_values(ELEMENTS, "by, nc, sa, nd")}),
names AS (SELECT ref_id, letters, own FROM {{names}}),
cc AS (
  SELECT ref_id, field_name, lower(regexp_extract(ref_id, '^CC-(BY[A-Z-]*)-[0-9]', 1)) AS code, version
  FROM terms WHERE ref_id RLIKE '^CC-BY'),
worded AS (
  SELECT ref_id, field_name, version, replace(code, '-', '') AS code,
         concat(by, CASE WHEN code LIKE '%-nc%' THEN nc ELSE '' END, CASE WHEN code LIKE '%-sa%' THEN sa ELSE '' END,
                CASE WHEN code LIKE '%-nd%' THEN nd ELSE '' END) AS words
  FROM cc CROSS JOIN elements),
scoped AS (
  SELECT w.*, s FROM worded w CROSS JOIN (SELECT explode(array('', 'international', 'unported', 'generic')) AS s)),
spelled AS (
  SELECT ref_id, field_name, version, explode(array(
    concat('cc', code), concat('creativecommons', code), code,
    concat('creativecommons', words, s), concat(words, s), concat('cc', words, s), concat(words, s, 'cc', code),
    concat('creativecommons', words, s, 'cc', code), concat(words, s, 'license'), concat('creativecommons', words, s, 'license'))) AS letters, '' AS own
  FROM scoped
  UNION ALL
  SELECT ref_id, field_name, {_figures("label")}, {_letters("label")}, '' FROM terms
  UNION ALL
  -- A name belongs to the entry whose id, or the first word of whose id, it is given under.
  SELECT t.ref_id, t.field_name, t.version, n.letters, n.own FROM names n JOIN terms t ON split(n.ref_id, '_')[0] = split(t.ref_id, '_')[0]
  UNION ALL
  -- Labels of several words without the joining ones, and without the ending of the first.
  SELECT ref_id, field_name, {_figures("label")}, explode(array({_letters(JOINLESS)}, {_letters("regexp_replace(" + JOINLESS + ", '^([a-z]+)ed[_ ]', '$1 ')")})), ''
  FROM terms WHERE label RLIKE '[_ ](for|of|the|to)[_ ]'),
aliases AS (
  SELECT DISTINCT ref_id, field_name, letters, f AS figures, {EDITS} AS k
  FROM (SELECT ref_id, field_name, letters, explode(array(version, own,
          array_join(array_sort(array_distinct(filter(split(concat(version, ',', own), ','), x -> x != ''))), ','))) AS f FROM spelled)
  WHERE letters != '')
"""

ALL_ALIASES = f"WITH {ALIASES} SELECT ref_id, field_name, letters, figures, k FROM aliases"

SAID = f"""
WITH typed AS (
  SELECT row_no, field_name, url,
         regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({FOLD.format(x="value")}, '[_\\u2010-\\u2015\\u00a0\\\\s]+', ' '), '[.;, ]+$', '')),
           '^published under the terms of the (.*?)(?: licen[sc]e)?$', '$1'), '{LEAD_IN.replace(chr(92), chr(92) * 2)}', '') AS value
  FROM (SELECT row_no, 'license' AS field_name, license AS value, {_address("license_url")} AS url FROM {{sources}}
        UNION ALL SELECT row_no, 'license_status', license_status, NULL FROM {{sources}})),
parsed AS (
  SELECT row_no, field_name,
         CASE WHEN value RLIKE '^(https?://)?[a-z0-9-]+([.][a-z0-9-]+)+/' THEN '' ELSE {_letters("coalesce(value, '')")} END AS letters,
         CASE WHEN value RLIKE '^(https?://)?[a-z0-9-]+([.][a-z0-9-]+)+/' THEN '' ELSE {_figures("coalesce(value, '')")} END AS figures,
         CASE WHEN value RLIKE '^(https?://)?[a-z0-9-]+([.][a-z0-9-]+)+/' THEN {_address("value")}
              WHEN regexp_replace(url, '[^a-z]', '') IN {SAYS_NOTHING} THEN NULL ELSE url END AS url,
         coalesce(trim(value), '') AS value
  FROM typed),
said AS (
  SELECT row_no, field_name, CASE WHEN letters IN {SAYS_NOTHING} AND field_name = 'license' THEN '' ELSE letters END AS letters, figures, url
  FROM parsed
  WHERE CASE WHEN field_name = 'license' THEN url IS NOT NULL OR letters NOT IN {SAYS_NOTHING} OR figures != '' ELSE value != '' END)
SELECT row_no, field_name, letters, figures, url FROM said
"""

MAPPED = f"""
WITH distinct_letters AS (SELECT DISTINCT field_name, letters FROM {{said}} WHERE letters != ''),
alias_segments AS (
  SELECT DISTINCT field_name, letters, k, length(letters) AS l, i,
         substring(letters, 1 + (i * length(letters)) div (k + 1), ((i + 1) * length(letters)) div (k + 1) - (i * length(letters)) div (k + 1)) AS seg
  FROM (SELECT DISTINCT field_name, letters, k FROM {{aliases}}) LATERAL VIEW explode(sequence(0, k)) AS i),
probes AS (
  SELECT DISTINCT field_name, letters, k, l, i,
         substring(letters, 1 + (i * l) div (k + 1) + shift, ((i + 1) * l) div (k + 1) - (i * l) div (k + 1)) AS seg
  FROM distinct_letters
  LATERAL VIEW explode(array(0, 1, 2)) AS k
  LATERAL VIEW explode(sequence(length(letters) - k, length(letters) + k)) AS l
  LATERAL VIEW explode(sequence(0, k)) AS i
  LATERAL VIEW explode(sequence(-k, k)) AS shift
  WHERE l > 0 AND (i * l) div (k + 1) + shift >= 0),
near AS (
  SELECT DISTINCT p.field_name, p.letters, a.letters AS alias
  FROM probes p JOIN alias_segments a ON p.field_name = a.field_name AND p.k = a.k AND p.l = a.l AND p.i = a.i AND p.seg = a.seg
  WHERE levenshtein(p.letters, a.letters) <= a.k),
named AS (
  SELECT n.field_name, n.letters, a.ref_id, a.figures, levenshtein(n.letters, n.alias) AS d
  FROM near n JOIN {{aliases}} a ON a.field_name = n.field_name AND a.letters = n.alias),
groups AS (
  SELECT field_name, letters, figures, url, count(*) AS n FROM {{said}} GROUP BY field_name, letters, figures, url),
meant AS (
  SELECT g.field_name, g.letters, g.figures, g.url, n.ref_id, n.d,
         min(n.d) OVER (PARTITION BY g.field_name, g.letters, g.figures, g.url) AS least
  FROM groups g JOIN named n ON g.field_name = n.field_name AND g.letters = n.letters AND (g.figures = n.figures OR g.figures = '')),
candidates AS (
  SELECT field_name, letters, figures, url, collect_set(ref_id) AS refs FROM meant WHERE d = least
  GROUP BY field_name, letters, figures, url),
known_names AS (SELECT DISTINCT field_name, letters FROM named),
by_url AS (SELECT url, min(ref_id) AS ref_id FROM (SELECT ref_id, {_address("url")} AS url FROM {{terms}}) WHERE url != '' GROUP BY url HAVING count(*) = 1),
decided AS (
  SELECT g.field_name, g.letters, g.figures, g.url,
         CASE WHEN size(c.refs) = 1 THEN c.refs[0]
              WHEN size(c.refs) > 1 THEN CASE WHEN array_contains(c.refs, u.ref_id) THEN u.ref_id END
              WHEN k.letters IS NULL THEN u.ref_id END AS ref_id
  FROM groups g
  LEFT JOIN candidates c ON g.field_name = c.field_name AND g.letters = c.letters AND g.figures = c.figures AND g.url <=> c.url
  LEFT JOIN known_names k ON g.field_name = k.field_name AND g.letters = k.letters
  LEFT JOIN by_url u ON g.field_name = 'license' AND g.url = u.url),
matched AS (SELECT * FROM decided WHERE ref_id IS NOT NULL)
SELECT s.row_no, s.field_name, m.ref_id
FROM {{said}} s JOIN matched m ON s.field_name = m.field_name AND s.letters = m.letters AND s.figures = m.figures AND s.url <=> m.url
UNION ALL
SELECT s.row_no, s.field_name, 'unmatched'
FROM {{said}} s LEFT ANTI JOIN matched m ON s.field_name = m.field_name AND s.letters = m.letters AND s.figures = m.figures AND s.url <=> m.url
"""


def found(sources: DataFrame, terms: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """row_no, field_name, ref_id (or `unmatched`) for every value that says something.

    `names` (ref_id, letters, own) are further names of entries, NAMES unless given. NULL, blank and placeholder
    values are no rows. Typed values are compared
    once each, however often they occur. A complete name wins over an address; a
    name that leaves the entry open takes it from the address; another version
    of a known name is unmatched whatever the address says. An empty list leaves
    every value unmatched.
    """
    spark = sources.sparkSession
    names = spark.createDataFrame(NAMES, "ref_id string, letters string, own string") if names is None else names
    # Wordings and typed values are read several times below.
    aliases = cut(spark.sql(ALL_ALIASES, terms=terms, names=names))
    said = cut(spark.sql(SAID, sources=sources.select("row_no", "license", "license_url", "license_status")))
    return spark.sql(MAPPED, aliases=aliases, said=said, terms=terms)


def unmatched(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """Typed values that fit no entry, with the number of rows."""
    return sources.sparkSession.sql(
        """SELECT field_name, value, address, count(*) AS n_rows FROM (
             SELECT f.field_name, CASE WHEN f.field_name = 'license' THEN s.license ELSE s.license_status END AS value,
                    CASE WHEN f.field_name = 'license' THEN s.license_url END AS address
             FROM {found} f JOIN {sources} s ON f.row_no = s.row_no WHERE f.ref_id = 'unmatched')
           GROUP BY field_name, value, address""",
        found=found(sources, terms),
        sources=sources,
    )
