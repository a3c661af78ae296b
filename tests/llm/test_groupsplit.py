import random

from granulate.llm import groupsplit as g


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(f"s:{rng.randrange(60)}", f"w:{rng.randrange(45)}") for _ in range(70)] + [(f"s:{100 + i}", f"w:{100 + i + j}") for i in range(30) for j in (0, 1)] + [("s:hub", f"w:h{i}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in g.components(spark.createDataFrame(edges, "a string, b string").distinct()).collect()}
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in list(got)[:40])


def test_found_and_assign(images, sources):
    src = sources(
        {"row_no": 1, "source_id": "A", "doi": "doi:10.1/X."}, {"row_no": 2, "source_id": " b ", "doi": "https://doi.example/10.1%2Fx"},
        {"row_no": 3, "source_id": "b", "doi": "10.2/y"}, {"row_no": 4, "source_id": "c", "doi": "10.2/Y"}, {"row_no": 5, "source_id": "d", "doi": "pending"},
        {"row_no": 6, "source_id": "e", "doi": "pending"}, {"row_no": 7, "source_id": None, "doi": "10.2/y"}, {"row_no": 8, "source_id": "z", "doi": "10.2/y"},
    )
    rows = [
        {"row_no": 1, "source_id": "a", "split": "train"}, {"row_no": 2, "source_id": "C ", "split": "Validation"}, {"row_no": 3, "source_id": "b", "split": None},
        {"row_no": 4, "source_id": "d", "split": "train"}, {"row_no": 5, "source_id": "e", "split": "test"}, {"row_no": 6, "source_id": "none", "split": "train"},
        {"row_no": 7, "source_id": "none", "split": "TESTING"}, {"row_no": 8, "source_id": None, "split": "val"}, {"row_no": 9, "source_id": "d", "split": "unassigned"},
    ]
    assert {r.source_id for r in g.found(images(*rows), src).collect()} == {"a", "b", "c", "none"}
    out = {r.row_no: (r.group, r.new_split) for r in g.assign(images(*rows), src).collect()}
    assert len(out) == 9 and out[1] == out[2] == out[3] and out[4] == out[9] and {s for _, s in out.values()} <= {"train", "val", "test"}
    assert g.found(images(), sources()).count() == 0 and g.assign(images(), sources()).count() == 0


def test_shares_with_a_hot_group(images, sources):
    rows = [{"row_no": i, "source_id": "hot" if i % 3 == 0 else f"s{i // 3}", "split": "train"} for i in range(3000)]
    out = g.assign(images(*rows), sources()).groupBy("new_split").count().collect()
    share = {r.new_split: r["count"] / 3000 for r in out}
    assert abs(share["train"] - 0.7) < 0.04 and abs(share["val"] - 0.15) < 0.04 and abs(share["test"] - 0.15) < 0.04
