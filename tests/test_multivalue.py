from granulate.operators import multivalue as m

NAMES = [f"{s}, {g}" for s in ("Skarn", "Brosk", "Tarn", "de la Mar") for g in ("Ilse", "Wim", "T. K.", "M.")]
TERMS = ["size, lateral", "drying and ageing", "TEM/STEM", "gold", "oxide films", "1,2-diol route", "colloids"]


def _rows():
    rows = [(i, "; ".join(NAMES[i % 16 : i % 16 + 3]), '["' + '", "'.join(TERMS[i % 7 :]) + '"]') for i in range(60)]
    rows += [(100 + i, f"{g} {s}, {g} {s}x and W. {s}", "; ".join(TERMS[i % 5 : i % 5 + 3])) for i, (s, g) in enumerate([("Skarn", "Ilse"), ("Brosk", "Wim"), ("Tarn", "Ebba")] * 6)]
    return rows


CASES = [
    ("Skarn, Ilse", ["Skarn, Ilse"], "size, lateral", ["size, lateral"]),
    ("Skarn, Ilse and de la Mar, M.", ["Skarn, Ilse", "de la Mar, M."], "gold / oxide films", ["gold", "oxide films"]),
    ("Ilse Skarn, W. Brosk, and Ebba Tarn", ["Ilse Skarn", "W. Brosk", "Ebba Tarn"], "drying and ageing, TEM/STEM", ["drying and ageing", "TEM/STEM"]),
    ('"Skarn, Ilse", "Brosk ""B"" Wim"', ["Skarn, Ilse", 'Brosk "B" Wim'], 'gold, "size, lateral", colloids,', ["gold", "size, lateral", "colloids"]),
    ("Tarn, Wim;; Brosk, M. |  ", ["Tarn, Wim", "Brosk, M."], "gold\r\n1,2-diol route\r\n", ["gold", "1,2-diol route"]),
    (None, [], "  ", []), ("", [], ";;,", []), ("[]", [], "[null, \"a\"]", ["a"]),
]


def test_split_fields(frame):
    rows = _rows() + [(1000 + i, a, k) for i, (a, _, k, _) in enumerate(CASES)] + [(2000, "x; " * 3000, "gold"), (2001, "x; " * 3000, " " * 20000 + "gold")]
    df = frame([r + ("clash",) for r in rows], "row_no long, authors string, keywords string, piece string")
    got = {}
    for r in m.split_fields(df, "row_no", ["authors", "keywords"]).orderBy("row_no", "field_name", "pos").collect():
        got.setdefault((r.row_no, r.field_name), []).append((r.pos, r.item))
    for i, (_, a, _, k) in enumerate(CASES):
        assert got.get((1000 + i, "authors"), []) == list(enumerate(a, 1)), CASES[i]
        assert got.get((1000 + i, "keywords"), []) == list(enumerate(k, 1)), CASES[i]
    assert len(got[2000, "authors"]) == len(got[2001, "authors"]) == 3000 and got[2001, "keywords"] == [(1, "gold")]


def test_empty(frame):
    assert m.split_fields(frame([], "row_no long, authors string, keywords string"), "row_no", ["authors", "keywords"]).count() == 0


LONG = "Institute of Rods, Cubes, Plates, Wires, Cages, Stars and Prisms"


def test_long_values_that_the_column_knows(frame):
    """A value with six inner separators comes out unquoted where the column shows it quoted once; alone it is a list."""
    names = ["Ada Morvane", "Bo Tarnholt", "Cy Deltoft", "Di Quibley"]
    rows = [(i, f"{names[i % 4]}; {names[(i + 1) % 4]}") for i in range(40)]
    rows += [(50, f'"{LONG}", Ada Morvane'), (51, f"Bo Tarnholt; {LONG}; Cy Deltoft"), (52, f"Ada Morvane, {LONG}, Bo Tarnholt"), (53, "Ada Morvane, Bo Tarnholt, Cy Deltoft, Di Quibley, Ada Morvane, Bo Tarnholt, Cy Deltoft")]
    got = {}
    for r in m.split_fields(frame(rows, "k long, authors string"), "k", ["authors"]).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r["item"])
    assert got[50] == [LONG, "Ada Morvane"] and got[51] == ["Bo Tarnholt", LONG, "Cy Deltoft"] and got[52] == ["Ada Morvane", LONG, "Bo Tarnholt"]
    assert got[53] == ["Ada Morvane", "Bo Tarnholt", "Cy Deltoft", "Di Quibley", "Ada Morvane", "Bo Tarnholt", "Cy Deltoft"]


def test_expected_counts_are_sums_over_all_splits():
    import itertools
    import math

    parts = ["A", "B", "C"]
    edges = [{"i": i, "j": j, "value": ",".join(parts[i:j]), "shape": ",".join("W" * (j - i)), "words": j - i, "c": (i + 1) * (j + 2) % 4, "s": 3 if j - i == 1 else 0} for i in range(3) for j in range(i + 1, 4)]
    p = {(e["i"], e["j"]): math.exp(m._log_p(e, 10.0)) for e in edges}
    splits = [[*zip((0, *c), (*c, 3))] for r in range(3) for c in itertools.combinations((1, 2), r)]
    each = [math.prod(p[a] for a in s) for s in splits]
    z, got = m.expected(edges, 10.0)
    assert abs(z - math.log(sum(each))) < 1e-9
    for e, x in zip(edges, got):
        want = sum(q for s, q in zip(splits, each) if (e["i"], e["j"]) in s) / sum(each)
        assert abs(x - want) < 1e-9
    best = max(zip(each, splits))[1]
    assert m.likeliest(edges, 10.0) == [",".join(parts[i:j]) for i, j in best]


def test_a_quote_is_closed_however_far_the_next_separator_is():
    assert m.pieces('"a, b"' + " " * 500 + "; c") == [("a, b", True), ("c", False)]
