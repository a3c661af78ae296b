"""Raster helpers, ordering, audits, records, readers and back-ends on small cases, nulls and empty tables among them."""

import numpy as np
import pytest
from granulate.operators import agreement, audits, backends, curation, ordering, pairing, raster, records, splits
from granulate.plans import phantoms
from granulate.sources import pages
from pyspark.sql import functions as F


def test_local_mask_finds_low_contrast_and_closes_gaps():
    g = np.full((80, 80), 120, np.uint8)
    g[30:50, 30:50] = 108
    m = raster.local_mask(g)
    assert m[40, 32] and m[32, 40] and not m[5, 5] and not m[75, 40]
    gap = np.zeros((20, 20), bool)
    gap[8:12, 3:9] = gap[8:12, 10:16] = True
    assert raster.close(gap, 3)[8:12, 9].all() and raster.close(gap, 3).sum() == gap.sum() + 4
    assert not raster.local_mask(np.full((10, 10), 7, np.uint8)).any()


def test_outlines_and_corners():
    m = np.zeros((12, 14), bool)
    m[2:7, 3:10] = True
    ring = raster.outline_of(m)
    assert len(ring) == len(set(ring)) == 2 * (5 + 7) - 4
    assert sorted(raster.simplify(ring, 1.0)) == [(3, 2), (3, 6), (9, 2), (9, 6)]
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    assert raster.outline_of(one) == [(1, 1)] and raster.outline_of(np.zeros((2, 2), bool)) == []


def test_mask_polygons_keep_labels_and_skip_broken_frames(frame):
    g = np.zeros((10, 10), np.uint8)
    g[1:4, 1:5], g[6:9, 6:9] = 1, 2
    rows = [(1, 10, 10, g.tobytes()), (2, 10, 10, b"x"), (3, None, 10, None)]
    got = raster.mask_polygons(frame(rows, "image_id long, width int, height int, data binary")).collect()
    assert {(r.image_id, r.label, len(r.polygon)) for r in got} == {(1, 1, 8), (1, 2, 8)}


def test_places_over_ranges(spark, frame):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = ordering.placed(df, ["v"], total="n").collect()
    assert all(r.place == r.v and r.n == 1000 for r in got) and len(got) == 1000
    assert ordering.placed(df.limit(0), ["v"]).count() == 0
    val = {r.v for r in ordering.every_nth(df, "v").where("val").collect()}
    assert val == set(range(0, 1000, 6)[:150])
    assert splits.running_val(frame([("a",), ("b",), ("b",), ("c",), ("d",)], "g string"), "g", 0.4).where("val").count() == 2
    assert curation.first_seen_ids(frame([("x", 3), ("y", 1), ("x", 0)], "c string, o long"), "c", "o").orderBy("id").first()["c"] == "x"


IMG = "row_no long, image_id string, source_id string, split string, file_sha256 string, nm_per_px string, license string, license_status string, source_url string, doi string"


def test_split_findings(frame):
    rows = [(1, "i", "a", "train", "s", "", "", "", "", ""), (2, "i", "a", "test", "s", "1", "x", "", "u", ""), (3, "i", "b", "odd", None, None, None, None, None, None), (4, "i", "c", "train", "t", "", "", "", "", ""), (5, "i", "c", "train", "t", "", "", "", "", "")]
    df = frame(rows, IMG)
    got = {tuple(r) for r in audits.split_findings(df, F.col("source_id"), F.lit("unknown")).collect()}
    assert got == {("error", "bad_split", "odd", 1), ("error", "group_in_several_splits", "a", 2), ("error", "duplicate_checksum", "s", 2), ("warning", "duplicate_checksum", "t", 2), ("error", "inexact_test", "unknown", 1)}
    assert {r.rule for r in audits.split_findings(df.limit(0), F.col("source_id"), F.lit("x")).collect()} == {"no_test_split"}
    gaps = {(r.kind, r["name"]): r.n for r in audits.dataset_gaps(df, F.col("source_id"), F.lit("l")).collect()}
    assert gaps["gap", "missing_license"] == 4 and gaps["error", "groups_in_several_splits"] == 1 and gaps["layer", "l"] == 5


def test_milestones(frame):
    targets = frame([(0, "small", 1, 1, 0), (1, "large", 9, 1, 0)], "place int, name string, min_images int, min_sources int, min_real_exact int")
    reached = lambda n: [r["name"] for r in audits.milestones(frame([(n, 3, 0)], "images long, sources long, real_exact long"), targets).where("reached").collect()]
    assert reached(0) == [] and reached(5) == ["small"] and reached(20) == ["large"]


def test_scale_has_an_order_of_precedence(frame):
    images = frame([(1, 100, 100, 50.0, 20.0, (10.0, 20.0, 40.0, 60.0)), (2, 100, 100, 50.0, 20.0, None), (3, 100, 100, 50.0, None, None), (4, 100, 100, 50.0, 0.0, None)],
                   "image_id long, width int, height int, scale_nm double, manual_px double, line struct<x1:double,y1:double,x2:double,y2:double>")
    c = frame([(i, s, 5.0, 6.0, 25.0, 2.0, q) for i in (1, 2, 3) for s, q in ((1, 0.2), (2, 0.9))], "image_id long, seq int, x double, y double, width_px double, height_px double, confidence double")
    got = {r.image_id: r for r in records.resolve_scale(images, c, ["image_id"]).collect()}
    assert [got[i].method for i in (1, 2, 3, 4)] == ["manual_line", "manual_override", "candidate", "none"]
    assert got[1].nm_per_px == 1.0 and (got[1].x, got[1].y, got[1].w, got[1].h) == (2, 12, 46, 56) and got[2].x is None and got[3].w == 25 and got[4].nm_per_px is None


def test_classes_are_inferred_or_asked_for(frame):
    c = lambda *n: frame([(i, x) for i, x in enumerate(n)], "id int, name string")
    assert records.class_names(c("a", "particle"), "name") == ["particle"] and records.class_names(c("a", None, " "), "name") == ["a"]
    with pytest.raises(ValueError):
        records.class_names(c("a", "b"), "name")
    with pytest.raises(ValueError, match="missing"):
        records.class_names(c("a"), "name", ["z"])
    assert [tuple(r) for r in records.category_map(c("a", "b"), "id", "name", ["b"]).collect()] == [(1, 0)]


def test_pairs_must_be_finite(frame):
    df = lambda *r: frame(list(r), "a double, b double")
    assert records.pairs_are_sound(df((1.0, 2.0)), "a", "b").count() == 1
    for bad in ([], [(1.0, None)], [(float("inf"), 1.0)]):
        with pytest.raises(Exception, match="pairs"):
            records.pairs_are_sound(df(*bad), "a", "b").collect()


def test_stronger_levels_win_even_if_blank(frame):
    images = frame([("i", "k", "own")], "id string, name string, split string")
    by_name = (frame([("k", "t1", "l1", "s1")], "name string, title string, licence string, split string"), "name")
    by_id = (frame([("i", "", "s2")], "id string, title string, split string"), "id")
    r = audits.merged_metadata(images, [by_name, by_id], ["title", "licence", "split"]).first()
    assert (r["title"], r["licence"], r["split"]) == ("", "l1", "own")


def test_backends_are_found_by_name_and_checked(frame):
    rows = frame([(1, 1, 2.0, 3.0, 4.0)], "image_id long, seq int, cx double, cy double, area_px double")
    assert backends.predict("manual", rows).first()["review_required"] is False and {n for n, _ in backends.available()} >= {"classical", "manual"}
    with pytest.raises(KeyError, match="known are"):
        backends.backend("none")
    backends.register("short", lambda f: f.drop("area_px"))
    with pytest.raises(ValueError, match="area_px"):
        backends.predict("short", rows)


def test_report_is_written_with_reasons(frame, spark, tmp_path):
    long = frame([("diameter", 10.0, 11.0, "", "m"), ("diameter", 10.0, 12.0, "", "m"), ("core", None, 2.0, "", "m")], "quantity string, ref double, mea double, status string, morphology string")
    rep = {r.quantity: r.undefined for r in agreement.write_report(long, ["morphology"], ["diameter", "core"], str(tmp_path / "r")).where("stratum = 'overall'").collect()}
    assert "r_squared_identity" in rep["diameter"] and rep["core"]["mae_percent"] == "fewer than two pairs"
    assert "# Agreement" in (next((tmp_path / "r/summary").glob("*.txt"))).read_text()


def test_unreadable_records_keep_their_row(frame):
    rows = [("https://figshare.com/articles/x/12", "not json", None), ("https://zenodo.org/records/5", '{"metadata": {"title": "T", "license": {"id": "cc-by-4.0"}}}', None), ("https://figshare.com/about", "{}", None), ("x.example/p", None, "refused"), (None, None, None)]
    got = [tuple(r) for r in pages.validated(frame(rows, "raw string, content string, error string")).select("status", "reason").collect()]
    assert got[:4] == [("done", "the record cannot be read"), ("done", "public licence found"), ("done", "no article id in the address"), ("error", "refused")] and len(got) == 5


def test_frames_are_read_once_and_dealt_out(spark, frame, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def look(data):
        read.add(1)
        return data

    g = np.full((64, 64), 90, np.uint8)
    g[30:32, 20:45], g[40:41, 5:50] = 255, 255
    images = frame([(i, 64, 64, g.tobytes()) for i in range(5)] + [(9, 64, 64, None)], "image_id long, width int, height int, data binary")
    seen = raster.scale_bars(images.withColumn("data", F.udf(look, "binary")("data")))
    got = pairing.scale_candidates(seen, ["image_id"]).collect()
    assert {(r.image_id, r.rank, r.x, r.y, r.w, r.h) for r in got} == {(i, *b) for i in range(5) for b in [(1, 20, 30, 25, 2), (2, 5, 40, 45, 1)]}
    assert read.value == 6
    spark.range(100).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = [n for n in phantoms._frames(spark, tmp_path, "bar").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 100 and phantoms.phantom_bars(spark, tmp_path).count() == 91


def test_boxes_and_components_by_flooding():
    rng = np.random.default_rng(5)
    for share in [0, 0.2, 0.4, 0.6, 1] * 20:
        m = rng.random(rng.integers(1, 14, 2)) < share
        labels, want = np.zeros(m.shape, int), []
        for y, x in np.argwhere(m):
            if not labels[y, x]:
                todo, at = [(y, x)], []
                labels[y, x] = len(want) + 1
                while todo:
                    cy, cx = todo.pop()
                    at.append((cx, cy))
                    for ny, nx in np.ndindex(*m.shape):
                        if abs(ny - cy) <= 1 and abs(nx - cx) <= 1 and m[ny, nx] and not labels[ny, nx]:
                            labels[ny, nx] = labels[y, x]
                            todo.append((ny, nx))
                xs, ys = zip(*at)
                want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert raster.components(m).tolist() == labels.tolist() and raster.boxes(m) == want
