import pytest

from granulate.llm import canonical

TERMS = [
    ("CC0-1.0", "license", "CC0 1.0 Universal", "https://terms.example/publicdomain/zero/1.0/"),
    ("CC-BY-3.0", "license", "Creative Commons Attribution 3.0 Unported", "https://terms.example/licenses/by/3.0/"),
    ("CC-BY-4.0", "license", "Creative Commons Attribution 4.0 International", "https://terms.example/licenses/by/4.0/"),
    ("CC-BY-NC-SA-4.0", "license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "https://terms.example/licenses/by-nc-sa/4.0/"),
    ("BSD-3-Clause", "license", "BSD 3-Clause License", None), ("GPL-3.0", "license", "GNU General Public License v3.0", None),
    ("MIT", "license", "MIT License", None), ("Apache-2.0", "license", "Apache License 2.0", None),
    ("accepted", "license_status", "accepted", None), ("needs_review", "license_status", "needs review", None),
]
CASES = [
    ("CC BY 4.0", None, "CC-BY-4.0"), ("cc_by_4.0", "", "CC-BY-4.0"), ("CCBY v4", None, "CC-BY-4.0"), ("Namensnennung 4.0", None, "CC-BY-4.0"),
    ("Creative Commons Attributtion 4.0 International", None, "CC-BY-4.0"), ("CC BY", None, "unmatched"), ("CC BY", "http://www.TERMS.example/licenses/by/3.0/deed.de", "CC-BY-3.0"),
    ("CC BY 5.0", None, "unmatched"), ("CC BY 5.0", "https://terms.example/licenses/by/4.0/", "unmatched"), (None, "terms.example/licenses/by/4.0?ref=x", "CC-BY-4.0"),
    ("n/a", "https://terms.example/licenses/by/4.0/legalcode", "CC-BY-4.0"), ("https://terms.example/licenses/by-nc-sa/4.0/", None, "CC-BY-NC-SA-4.0"),
    ("Attribution - Pas d'utilisation commerciale - Partage dans les mêmes conditions 4.0", None, "CC-BY-NC-SA-4.0"), ("CC-BY-NC-SA-3.0", None, "unmatched"),
    ("Published under the terms of the CC zero 1.0 licence", None, "CC0-1.0"), ("cc0", None, "CC0-1.0"), ("3-clause BSD", None, "BSD-3-Clause"), ("GPLv1", None, "unmatched"),
    ("GPL 3", None, "GPL-3.0"), ("mit licence", None, "MIT"), ("apache-2", None, "Apache-2.0"), ("freeware", None, "unmatched"), ("x" * 100000, None, "unmatched"),
    ("None", None, None), (None, None, None), (" - ", "", None), ("", "  ", None), ("Creative Commons", "terms.example/licenses/by/4.0", "CC-BY-4.0"),
]
STATUS = [("Accepted", "accepted"), ("acceptd", "accepted"), ("needs-review.", "needs_review"), ("42", "unmatched"), ("-", "unmatched"), ("  ", None), (None, None)]


@pytest.fixture
def terms(spark):
    return lambda rows=TERMS: spark.createDataFrame(rows, "ref_id string, field_name string, label string, url string")


def test_cases(sources, terms):
    rows = [{"row_no": i, "license": a, "license_url": u} for i, (a, u, _) in enumerate(CASES)] + [{"row_no": 500 + i, "license_status": s} for i, (s, _) in enumerate(STATUS)]
    got = {(r.row_no, r.field_name): r.ref_id for r in canonical.found(sources(*rows), terms()).collect()}
    assert got == {(i, "license"): w for i, (_, _, w) in enumerate(CASES) if w} | {(500 + i, "license_status"): w for i, (_, w) in enumerate(STATUS) if w}


def test_repeats_and_empty(sources, terms):
    rows = [{"row_no": i, "license": "MIT"} for i in range(50)]
    assert canonical.found(sources(*rows), terms()).where("ref_id = 'MIT'").count() == 50
    assert canonical.found(sources(), terms()).count() == 0
    assert {r.ref_id for r in canonical.found(sources(*rows), terms([])).collect()} == {"unmatched"}
    assert canonical.unmatched(sources({"row_no": 1, "license": "freeware"}, {"row_no": 2, "license": "freeware"}), terms()).first()["n_rows"] == 2


def test_names_are_an_argument(sources, terms, spark):
    """A reference list of other things, with its own further names."""
    cities = [("BER", "license", "Berlin", None), ("MUC", "license", "Munich am Isar", None)]
    names = spark.createDataFrame([("MUC", "muenchen", ""), ("MUC", "monacodibaviera", "")], "ref_id string, letters string, own string")
    rows = [{"row_no": i, "license": v} for i, v in enumerate(["berlin", "MUENCHEN", "Monaco di Bavera", "Munich am Isr", "Paris", "MIT"])]
    got = {r.row_no: r.ref_id for r in canonical.found(sources(*rows), terms(cities), names).collect()}
    assert got == {0: "BER", 1: "MUC", 2: "MUC", 3: "MUC", 4: "unmatched", 5: "unmatched"}
