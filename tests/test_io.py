"""Readers, writers, pages, streams and rasters on small inputs."""

import json
import math

import numpy as np
import pytest
from granulate.operators import outlines, raster
from granulate.sources import pages, sinks, tables
from granulate.streaming import edits
from pyspark.sql import functions as F


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,v,x\n1,"a, ""b""",9\n2,,8\n')
    assert [tuple(r) for r in tables.csv_fixed(spark, str(p), ["id", "v", "w"]).collect()] == [("1", 'a, "b"', ""), ("2", "", "")]
    assert tables.csv_fixed(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0
    sinks.write_csv(tables.csv_any(spark, str(p)), str(tmp_path / "out"), ["id", "v", "new"], one=True)
    assert tables.csv_any(spark, str(tmp_path / "out")).count() == 2


def test_validation_table(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("image_id,particle_id,reference_diameter_nm,measured_diameter_nm,status\n i1 ,p1,10,11,\ni1,p2,n/a,inf,ambiguous\n")
    assert [tuple(r) for r in tables.validation_table(spark, str(p)).collect()] == [("i1", "p1", "", 10.0, 11.0), ("i1", "p2", "ambiguous", None, None)]
    p.write_text("image_id,particle_id,reference_diameter_nm,measured_diameter_nm\ni,p,ten,1\n")
    with pytest.raises(Exception, match="is no number"):
        tables.validation_table(spark, str(p)).collect()
    p.write_text("image_id,x\n1,2\n")
    with pytest.raises(ValueError):
        tables.validation_table(spark, str(p))


def test_coco_and_labels(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 10, "metadata": {"split": "val"}}], "categories": [{"id": 5, "name": "silica"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 5, "segmentation": [[0, 0, 10, 0, 10, 10]], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 5, "segmentation": [[0, 0, 5, 0, 5, 5]], "iscrowd": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    d = tables.coco(spark, str(tmp_path / "c.json"))
    img, ann = outlines.images_of(d), outlines.annotations_of(d)
    assert img.first().split == "val"
    lines = outlines.label_lines(ann, img).collect()
    assert len(lines) == 1 and lines[0].line.startswith("1 0.000000 0.000000 1.000000")
    (tmp_path / "l.txt").write_text("1 0 0 1 0 1 1\nx 0 0 1 0 1 1\n0 0 0 1\n0 0 0 2 0 1 1\n")
    assert sorted(str(r.error) for r in tables.labels(spark, str(tmp_path / "l.txt")).collect()) == ["None", "bad class", "bad outline", "outside the frame"]
    assert tables.listing(spark, str(tmp_path), "*.txt").first().stem == "l" and len(tables.checksums(spark, str(tmp_path), "*.txt").first().file_sha256) == 64


def test_registry_and_config():
    got = tables.registry("version: 1\ndatasets:\n  - id: a  # note\n    tags: [x, 'y z']\n    enabled: true\n  - id: \"b # c\"\n    checksum:\n")
    assert got == [{"id": "a", "tags": ["x", "y z"], "enabled": True}, {"id": "b # c", "checksum": None}]
    assert tables.run_config("epochs: 5\nname: 'n'\n") == {"epochs": "5", "name": "n"} and tables.run_config('{"a": 1}') == {"a": 1}


def test_pages(frame):
    html = '<html><head><title> T </title><meta name="citation_author" content="A, B"><meta name="citation_author" content="C"><meta name="citation_date" content="2020/05"><link rel="license" href="https://l"></head><body><img src="fig1.png" alt="TEM"><img src="/logo.png"><figure><figcaption> Cap <b>x</b></figcaption></figure>'
    m = pages.metadata(frame([(1, "https://a.example/p/", html), (2, None, None)], "page_id long, url string, html string"))
    r = {x.page_id: x for x in m.collect()}
    assert (r[1].title, r[1].authors, r[1].year, r[1].license_url, r[1].captions) == ("T", "A, B; C", "2020", "https://l", ["Cap x"]) and r[2].title == "" and r[2].error is None
    assert [x.address for x in pages.figures(m, 5).collect()] == ["https://a.example/p/fig1.png"]
    j = '{"metadata": {"title": "t", "publication_date": "2019-01-02", "creators": [{"name": "A"}, {"name": "B"}], "license": {"id": "cc-by-4.0"}}}'
    x = frame([(j,), ("{",)], "j string").select(pages.record(F.col("j")).alias("r")).collect()
    assert (x[0].r.authors, x[0].r.year, x[0].r.license_status) == ("A; B", "2019", "accepted")


def test_sinks(frame):
    assert json.loads(sinks.json_lines(frame([(1, None)], "b int, a string")).first().value) == {"a": None, "b": 1}
    rows = frame([(1, 1, "x", 5.0), (1, 2, "y", 6.0), (2, 1, "y", 7.0)], "image_id int, seq int, class string, diameter double")
    assert {(r.image_id, r.diameter) for r in sinks.diameters(rows, ["image_id"], "x").collect()} == {(1, 5.0), (2, 7.0)}
    assert "| 1.500 |" in sinks.markdown([{"a": 1.5}], ["a"], "t")


def test_stream(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    ddl = "k string, ts timestamp, v int"
    make = lambda rows: spark.createDataFrame(rows, "k string, s string, v int").select("k", F.to_timestamp("s").alias("ts"), "v")
    make([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:01:00", 2), ("b", "2024-01-01 00:00:00", 3)]).write.parquet(src)
    for n in (0, 1):
        edits.upsert_stream(edits.edit_stream(spark, src, ddl), "k", "ts", table, str(tmp_path / "c")).start().awaitTermination()
        if not n:
            make([("a", "2023-01-01 00:00:00", 9), ("c", "2024-01-02 00:00:00", 4)]).write.mode("append").parquet(src)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{table}/v=1").collect()} == {("a", 2), ("b", 3), ("c", 4)}


def test_raster(frame):
    g = raster.disc_frame(200, 150, [(40, 50, 20), (120, 90, 12)])
    df = frame([(1, 200, 150, bytearray(g.tobytes())), (2, 200, 150, None), (3, 10, 10, bytearray(b"x"))], "image_id long, width int, height int, data binary")
    d = raster.detect(df).orderBy("seq").collect()
    assert [r.image_id for r in d] == [1, 1]
    for r, (cx, cy, rad) in zip(d, [(40, 50, 20), (120, 90, 12)]):
        assert abs(r.cx - cx) < 0.5 and abs(r.cy - cy) < 0.5 and abs(r.major_px - 2 * rad) < 1.5 and abs(r.area_px - math.pi * rad**2) < 40
    u = np.zeros((5, 7), bool)
    u[0, [0, 6]] = u[1, [1, 5]] = u[2, 2:5] = True
    assert raster.components(u).max() == 1
    assert raster.overlap(u, u) == (1.0, 1.0) and raster.overlap(u & False, u & False) == (1.0, 1.0)
    assert raster.fill([1, 1, 5, 1, 5, 4, 1, 4], 8, 6).sum() == 12 and len(raster.small_hash(g)) == 64
    assert raster.grey(np.dstack([g, g, g])).tolist() == g.tolist()


def test_page_fields_and_licences(frame):
    head = lambda *m: "<head>" + "".join(f'<meta name="{n}" content="{c}">' for n, c in m) + "</head>"
    rows = [
        (1, head(("dc.identifier", "a"), ("dc.identifier.doi", "10.1/b"), ("prism.publicationName", "J"), ("article:published_time", "on 2021-03-04"), ("dc.description", "first"), ("description", "second"))),
        (2, head(("dc.rights", "CC BY 4.0"), ("dc.rights", "https://creativecommons.org/licenses/by/4.0/"))),
        (3, "<p>Shared under <b>CC BY-NC</b></p>"), (4, '<a rel="license" href="https://creativecommons.org/licenses/by/4.0/">x</a>'), (5, "<p>none</p>"),
    ]
    r = {x.page_id: x for x in pages.metadata(frame([(i, "https://a.example/", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert (r[1].doi, r[1].journal, r[1].year, r[1].abstract) == ("10.1/b", "J", "2021", "first")
    assert [r[i].license_status for i in (2, 3, 4, 5)] == ["accepted", "rejected", "accepted", "missing"]
    assert r[2].license_url == r[4].license_url == "https://creativecommons.org/licenses/by/4.0/"
