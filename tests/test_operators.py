"""Measurement operators against plain loops, edge cases and invariants."""

import math
import random

import pytest
from granulate.functions import geometry as g
from granulate.operators import agreement, curation, distribution, figures, outlines, pairing, splits
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DET = "image_id long, seq int, cx double, cy double, radius_px double"


def _dets(seed, images=6, most=14):
    rng = random.Random(seed)
    return [(i, s + 1, float(rng.randrange(120)), float(rng.randrange(120)), float(rng.choice([4, 10, 25]))) for i in range(images) for s in range(rng.randrange(most))]


def _greedy(first, second, reach):
    out, used = set(), set()
    for i, s, x, y, r in sorted(first):
        free = [(math.sqrt((x - q[2]) ** 2 + (y - q[3]) ** 2), q[1]) for q in second if q[0] == i and (i, q[1]) not in used]
        near = [f for f in free if f[0] <= reach(r)]
        if near:
            used.add((i, min(near)[1]))
            out.add((i, s, min(near)[1]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_is_the_greedy_walk(frame, seed):
    a, b = _dets(seed), _dets(seed + 50)
    fa, fb = frame(a, DET), frame(b, DET)
    rows = lambda df: {(r.image_id, r.a, r.b) for r in df.collect()}
    assert rows(pairing.pair_outer(fa, fb, ["image_id"])) == _greedy(a, b, lambda r: max(0.8 * r, 8))
    assert rows(pairing.pair_inner(fa, fb, ["image_id"])) == _greedy(a, b, lambda r: max(1.4 * r, 12))
    assert rows(pairing.pair_any(fa, fb, ["image_id"])) == _greedy(a, b, lambda r: math.inf)


def test_deduplicate_is_the_walk(frame):
    rows = _dets(7, 4, 25)
    kept = []
    for r in sorted(rows):
        if not any(k[0] == r[0] and math.hypot(k[2] - r[2], k[3] - r[3]) < max(k[4], r[4], 1) * 0.65 for k in kept):
            kept.append(r)
    assert {(r.image_id, r.seq) for r in pairing.deduplicate(frame(rows, DET), ["image_id"]).collect()} == {r[:2] for r in kept}
    assert pairing.deduplicate(frame([], DET), ["image_id"]).count() == 0


def test_crowded_images_are_settled_in_rounds_with_the_same_rows(frame, monkeypatch):
    a, b = _dets(3, 1, 9)[:7], _dets(60, 1, 14)[:6]
    fa, fb = frame(a, DET), frame(b, DET)
    rows = lambda df: {(r.image_id, r.a, r.b) for r in df.collect()}
    near = pairing.near_pairs(fa, fb, ["image_id"], F.lit(90.0))
    assert rows(pairing.serial_choice(near, ["image_id"], crowded=5)) == rows(pairing.serial_choice(near, ["image_id"])) == _greedy(a, b, lambda r: 90)
    assert a and b
    same = pairing.duplicates(fa, ["image_id"], 2.0)
    assert {tuple(r) for r in pairing.first_come(fa, same, ["image_id"], crowded=5).select("image_id", "seq").collect()} == {tuple(r) for r in pairing.first_come(fa, same, ["image_id"]).select("image_id", "seq").collect()}
    monkeypatch.setattr(pairing, "CROWDED", 10)
    small_a, small_b = a[:4], b[:4]
    assert rows(pairing.pair_any(frame(small_a, DET), frame(small_b, DET), ["image_id"])) == _greedy(small_a, small_b, lambda r: math.inf)


def test_one_large_reach_does_not_flood_the_cells(frame):
    rows = [(1, i, float(i % 100), float(i // 100), 2.0) for i in range(1000)]
    wide = frame([(1, 0, 50.0, 5.0, 1e7)], DET)
    assert pairing.near_pairs(wide, frame(rows, DET), ["image_id"], F.col("radius_px")).count() == 1000


def test_one_image_of_100000_detections(spark):
    df = spark.range(100000).selectExpr("1L image_id", "int(id) seq", "double(id % 1000) * 10 cx", "double(id div 1000) * 10 cy", "4.0D radius_px")
    assert pairing.deduplicate(df, ["image_id"]).count() == 100000
    assert pairing.pair_outer(df, df, ["image_id"]).where("a = b and d = 0").count() == 100000


def test_pairing_of_nothing(frame):
    assert pairing.pair_outer(frame([], DET), frame(_dets(1), DET), ["image_id"]).count() == 0


def test_agreement_values(frame):
    rows = [(10.0, 11.0, ""), (20.0, 21.0, ""), (30.0, 31.0, None), (None, 5.0, ""), (7.0, None, ""), (None, None, ""), (9.0, 9.0, " Ambiguous ")]
    df = frame([("diameter", a, b, s, "m") for a, b, s in rows], "quantity string, ref double, mea double, status string, morphology string")
    r = agreement.report(df, ["morphology"], ["diameter", "core"]).collect()
    assert {(x.stratum, x.quantity) for x in r} == {("overall", "diameter"), ("overall", "core")}  # one value: no stratum
    x = next(x for x in r if x.quantity == "diameter")
    assert (x.n, x.mae, x.mean_bias, x.missed, x.extra, x.flagged) == (3, 1.0, 1.0, 2, 2, 1) and x.r_squared_identity == 0.985 and x.pearson_r == 1.0
    assert abs(x.limit_low - 1) < 1e-6 and x.target_pass is True
    core = next(x for x in r if x.quantity == "core")
    assert core.n == 0 and core.mae is None and core.target_pass is None
    reasons = {(x.reason): x.n_rows for x in agreement.reasons(df, []).collect()}
    assert reasons == {"no_reference_value": 1, "missed_particle": 1, "flagged_ambiguous": 1}


def test_constant_reference_is_undefined(frame):
    df = frame([("diameter", 5.0, float(i), "", "") for i in range(4)], "quantity string, ref double, mea double, status string, mode string")
    x = agreement.report(df, [], ["diameter"]).first()
    assert x.r_squared_identity is None and x.pearson_r is None and x.rmse >= x.mae


def test_distribution_hints(frame):
    vals = [("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8)] + [("b", 1.0), ("b", -1.0), ("b", None), ("c", 0.0), ("d", float("nan"))] + [("e", 2.0)] * 9
    got = {r.k: (r.n, r.hint) for r in distribution.distribution(frame(vals, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": (8, "roughly_normal"), "b": (1, "insufficient_n"), "c": (0, "no data"), "d": (0, "no data"), "e": (9, "insufficient_n")}


def test_histogram_keeps_empty_bins(frame):
    h = distribution.histogram(frame([("a", 0.5), ("a", 9.5), ("a", None)], "k string, v double"), ["k"], "v", 1.0).orderBy("bin").collect()
    assert [r.n for r in h] == [1] + [0] * 8 + [1]
    assert distribution.histogram(frame([], "k string, v double"), ["k"], "v").count() == 0


def test_objects(frame):
    t = "struct<cx:double,cy:double,major:double,minor:double,equivalent:double,flags:array<string>>"
    one = lambda m, *f: (1.0, 2.0, m, m, m, list(f))
    df = frame([(1, 1, one(10.0), one(20.0), []), (1, 2, one(1.0), one(20.0, "edge"), []), (1, 3, None, one(5.0), []), (1, 4, one(5.0, "watershed_split"), None, [])], f"image_id int, place int, inner {t}, outer {t}, flags array<string>")
    o = {r.object_id: r for r in pairing.assemble(df, ["image_id"], "spheres").collect()}
    assert o["obj_0001"].shell_thickness == 5 and o["obj_0001"].review_status == "ready" and o["obj_0001"].confidence_score == 1.0
    assert o["obj_0002"].flags == ["edge", "low_confidence", "ratio_outlier"] and o["obj_0002"].confidence_score == 0.6
    assert o["obj_0003"].flags == ["unpaired_inner"] and o["obj_0003"].pair_status == "partial"
    assert o["obj_0004"].separation_method == "watershed"


def test_split_ranks(frame):
    import hashlib

    names = [f"g{i}" for i in range(40)]
    got = {r.k: r.place for r in splits.ranked(frame([(n,) for n in names * 2], "k string"), "k").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: hashlib.sha1(n.encode()).hexdigest()))}
    one = splits.assign(frame([(1, "a"), (2, None)], "id int, k string"), "k").collect()
    assert {r.id: r.new_split for r in one} == {1: "train", 2: "train"}


def test_near_duplicates_match_all_pairs(frame):
    rng = random.Random(3)
    base = ["".join(rng.choice("01") for _ in range(64)) for _ in range(8)]
    rows = []
    for i in range(60):
        h = list(rng.choice(base))
        for p in rng.sample(range(64), rng.randrange(0, 6)):
            h[p] = "1" if h[p] == "0" else "0"
        rows.append((i, "".join(h)))
    rows += [(100, None), (101, ""), (102, rows[0][1])]
    reps = {}
    for k, h in rows:
        if h:
            reps[h] = min(k, reps.get(h, k))
    want = {(min(a, b), max(a, b)) for x, a in reps.items() for y, b in reps.items() if a != b and sum(p != q for p, q in zip(x, y)) <= 3}
    assert {(r.a, r.b) for r in splits.near_duplicates(frame(rows, "k int, h string"), "k", "h").collect()} == want


def test_copies_are_in_classes(spark, frame, tmp_path):
    """With the classes, the pairs of representatives give all pairs of rows, exact copies too; the query has every row."""
    from granulate.plans import registry

    a, b = "01" * 32, "01" * 31 + "11"
    rows = [(i, a if i % 3 else b) for i in range(9)] + [(20, "0" * 64), (21, None), (22, ""), (23, "")]
    df = frame(rows, "k int, h string")
    rep = {r.k: r.representative for r in splits.classes(df, "k", "h").collect()}
    near = {(r.a, r.b) for r in splits.near_duplicates(df, "k", "h").collect()}
    full = {k: h for k, h in rows if h}
    want = {(x, y) for x in full for y in full if x < y and sum(p != q for p, q in zip(full[x], full[y])) <= 3}
    assert {(x, y) for x in rep for y in rep if x < y and (rep[x] == rep[y] or tuple(sorted((rep[x], rep[y]))) in near)} == want
    vectors = frame([(i, "l", [float(i % 2), 0.5] * 32) for i in range(6)], "vec_id long, label string, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.representative for r in registry.QUERIES["near_duplicate_classes"](spark, str(tmp_path)).collect()}
    assert got == {i: i % 2 for i in range(6)}


def test_upsert_and_edits(frame):
    old = frame([("a", "1", "x"), ("b", "2", "y")], "id string, v string, w string")
    new = frame([("a", "", 1), ("a", "9", 2), ("c", "3", 1), (None, "4", 1), (" ", "5", 1)], "id string, v string, o int")
    assert {(r.id, r.v, r.w) for r in curation.upsert(old, new, "id", "o").collect()} == {("a", "9", "x"), ("b", "2", "y"), ("c", "3", None)}
    objects = frame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "id string, value double")
    edits = frame([("a", 1, "update", 5.0), ("a", 2, "reject", 0.0), ("b", 1, "update", 7.0), ("d", 1, "add", 8.0), ("c", 1, "add", 9.0)], "id string, o int, action string, value double")
    assert {(r.id, r.value) for r in curation.apply_edits(objects, edits, "id", "o").collect()} == {("b", 7.0), ("c", 3.0), ("d", 8.0)}


def test_runs(frame):
    flags = [True, True, False, True, True, True, False, True]
    got = figures.runs(frame([("r", i, f) for i, f in enumerate(flags)], "g string, i int, f boolean"), ["g"], "i", "f", 2)
    assert {(r.start, r.end) for r in got.collect()} == {(0, 2), (3, 6)}


def test_geometry(spark, frame):
    df = frame([([0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0],), ([0.0, 0.0, 1.0],), ([],)], "p array<double>")
    r = df.select(g.polygon_area(F.col("p")).alias("a"), g.polygon_normalise(F.col("p"), F.lit(2), F.lit(3)).alias("n")).collect()
    assert [x.a for x in r] == [12.0, 0.0, 0.0] and r[0].n == [0, 0, 1, 0, 1, 1, 0, 1] and r[1].n is None
    one = spark.range(1).select(
        g.scale_line(F.lit("0,0,3, 4"))["length"].alias("l"), g.scale_line(F.lit("1,1,1,1")).alias("z"), g.scale_line(F.lit("1,a,1,1")).alias("y"), g.shape_class(F.lit(0.9), F.lit(1.2)).alias("s"),
        g.aspect_panels(F.lit(3000), F.lit(1000)).alias("p"), g.tile_grid(F.lit(2000), F.lit(900)).alias("t"), g.truthy(F.lit("Off")).alias("b"), g.clamped_range(F.lit(300), F.lit(-5), 0, 255).alias("c"),
        g.nm_per_pixel(F.lit(100), F.lit(0)).alias("n"), g.boxes_at(F.lit(10), F.lit(8), F.array(F.lit(4)), F.array().cast("array<int>")).alias("x"),
    ).first()
    assert one.l == 5 and one.z is None and one.y is None and one.s == "round" and len(one.p) == 3 and one.p[2].x2 == 3000
    assert [(x.y, x.x) for x in one.t] == [(0, 0), (0, 819), (0, 976)] and one.b is False and (one.c.low, one.c.high) == (0, 255) and one.n is None
    assert [(b.x1, b.x2) for b in one.x] == [(0, 4), (4, 10)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(0.1, 1e4), st.floats(0.1, 1e4))
def test_shell_and_ratio_invariants(spark, a, b):
    r = spark.range(1).select(g.shell_thickness(F.lit(a), F.lit(b)).alias("s"), g.core_outer_ratio(F.lit(b), F.lit(a)).alias("q")).first()
    assert r.s >= 0 and (r.s == 0 or abs(2 * r.s + b - a) < 1e-6) and abs(r.q * a - b) < 1e-6 * max(a, b)


def test_outlines(frame):
    sq = lambda x, s: [[x, x, x + s, x, x + s, x + s, x, x + s]]
    ann = frame([(1, 1, "silica", sq(0.0, 100.0), None), (2, 1, "gold core", sq(25.0, 50.0), None), (3, 1, "shell", sq(300.0, 40.0), "uncertain"), (4, 1, "odd", sq(0.0, 5.0), None), (5, 1, "au", [], None)], "id long, image_id long, category string, segmentation array<array<double>>, review_status string")
    img = frame([(1, 400, 400, "2.0")], "id long, width int, height int, nm_per_px string")
    rows = outlines.core_shell(outlines.measured(ann, img)).collect()
    assert len(rows) == 2 and {r.pair_status for r in rows} == {"paired", "missing_core"}
    first = next(r for r in rows if r.pair_status == "paired")
    assert abs(first.total_nm - 2 * math.sqrt(40000 / math.pi)) < 1e-9 and first.centre_distance_px == 0
    assert {r.id for r in outlines.label_lines(ann, img).collect()} == {1, 2}
    assert {r.reason: r.n for r in outlines.skipped(ann, img).collect()} == {"needs review": 1, "unknown category": 1, "no usable outline": 1}
