from granulate.functions import normalise as n
from granulate.functions import text as t
from pyspark.sql import functions as F


def _map(frame, fn, values):
    return [r[0] for r in frame([(v,) for v in values], "v string").select(fn(F.col("v"))).collect()]


def test_digests_and_hashes(frame):
    h = "ab" * 32
    assert _map(frame, n.sha256_digest, [h, "SHA256:" + h.upper(), f"sha256-{h}\n", " " + h, "0" * 64, n.EMPTY_SHA256, "pending", "", None]) == [h] * 4 + [None] * 5
    assert _map(frame, n.hex64, [h.upper(), "f" * 64, h[:-1], None]) == [h, None, None, None]


def test_addresses(frame):
    same = ["https://www.a.example:443/%7Eb/c?x=1&y=2&utm_source=f", "http://A.example/~b/c/?y=2&x=1#top", "a.example/~b/c?x=1&y=2&sessionid=9"]
    got = _map(frame, n.url_resource, [*same, "https://a.example/~B/c?x=1&y=2", "", None, "x%"])
    assert got[0] == got[1] == got[2] != got[3] and got[4:6] == [None, None] and got[6]
    assert _map(frame, n.url_host, ["HTTPS://WWW.A.example:443/x", "b.example:8080", " ", None]) == ["a.example", "b.example:8080", None, None]


def test_dois_ids_splits(frame):
    assert _map(frame, n.doi, ["DOI: 10.99/A.b.", "http://d.example/10.99%2Fa.b", "10.99/a.b ", "pending", None]) == ["10.99/a.b"] * 3 + [None] * 2
    assert _map(frame, n.ident, [" Src_1 ", "", None]) == ["src_1", None, None]
    assert _map(frame, n.split_name, ["TRAIN ", "training", "valid", "Test", "unassigned", "", None]) == ["train", "train", "val", "test", None, None, None]


def test_rules(frame):
    assert _map(frame, t.modality, ["HAADF image", "system", "temperature", "semantic", "", None]) == ["HAADF", "STEM", "TEM", "SEM", "unknown", "unknown"]
    assert _map(frame, t.licence_status, ["CC BY 4.0", "cc-by-nc", "", None, "mit"]) == ["accepted", "rejected", "missing", "missing", "rejected"]
    assert _map(frame, t.class_name, ["Gold-core", "silica", "x_y", None]) == ["Au_core", "SiO2_outer", "x_y", None]
    assert _map(frame, t.source_address, ["doi: 10.1/x", "10.1234/x", "a.b/c", "http://a.b", " "]) == ["https://doi.org/10.1/x", "https://doi.org/10.1234/x", "https://a.b/c", "http://a.b", ""]
    assert _map(frame, t.number, ["1.5", " n/a ", "inf", "x", None]) == [1.5, None, None, None, None]
    assert _map(frame, t.key_values, ['{"a": "1"}', "a=1; b = 2", ""]) == [{"a": "1"}, {"a": "1", "b": "2"}, {}]
    assert _map(frame, lambda c: t.hamming(c, F.lit("0101")), ["0111", "01", "", None]) == [1, None, None, None]
