"""Problems 2 and 6 against brute force."""

import random

import pytest

from granulate.functions import normalise
from granulate.llm import bits, crosssplit, history
from pyspark.sql import functions as F

EMPTY = normalise.EMPTY_SHA256


def _hash(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(64))


def _flip(h, k, rng):
    n = int(h, 16)
    for b in rng.sample(range(256), k):
        n ^= 1 << b
    return f"{n:064x}"


def _ham(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def _norm_digest(x):
    x = (x or "").strip().lower()
    for p in ("sha256:", "sha256-"):
        x = x.removeprefix(p)
    return x if len(x) == 64 and len(set(x)) > 1 and x != EMPTY else None


def _rows(n=120, seed=3):
    rng = random.Random(seed)
    base = [_hash(rng) for _ in range(25)]
    digests = [_hash(rng) for _ in range(30)]
    rows = []
    for i in range(n):
        h = rng.choice([None, "", "0" * 64, "F" * 64, _flip(rng.choice(base), rng.choice([0, 1, 6, 11, 12, 13, 20]), rng)])
        d = rng.choice([None, "pending", EMPTY, "a" * 64, rng.choice(digests), "SHA256:" + rng.choice(digests).upper(), "sha256-" + rng.choice(digests) + "\n"])
        rows.append({"row_no": i, "ahash": h, "file_sha256": d, "split": rng.choice(["train", "TRAIN ", "training", "val", "Test", "testing", None, "", "unassigned"]), "curation_status": rng.choice(["accepted", "Accepted ", "rejected", None]), "image_id": rng.choice([f"img_{i}", " IMG_7", "img_7", None, ""]), "source_url": rng.choice([None, "https://a.example/x?b=1&a=2", "http://www.A.example:80/x/?a=2&b=1&utm_q=3#f", f"https://a.example/{i}"])})
    return rows


def _near(a, b):
    ok = lambda h: h and len(set(h)) > 1
    return ok(a) and ok(b) and _ham(a, b) <= 12


def _same_image(a, b):
    x, y = _norm_digest(a["file_sha256"]), _norm_digest(b["file_sha256"])
    return x is not None and x == y or _near(a["ahash"], b["ahash"])


def test_images_across_splits(images, spark):
    rows = _rows()
    side = lambda r: {"train": 1, "training": 1, "val": 0, "test": 0, "testing": 0}.get((r["split"] or "").strip().lower())
    want = {(a["row_no"], b["row_no"]) for a in rows for b in rows if a["row_no"] < b["row_no"] and None not in (side(a), side(b)) and side(a) != side(b) and _same_image(a, b)}
    tri = spark.createDataFrame([], "tile_no long, tile_path string, split string, width string, height string, source_pdf string")
    got = [(r.key_a, r.key_b) for r in crosssplit.found(images(*rows), tri).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert crosssplit.found(images(), tri).count() == 0
    assert crosssplit.counts(images(*rows), tri).agg(F.sum("pairs")).first()[0] == len(want)


def test_radius_is_checked(images):
    with pytest.raises(ValueError):
        crosssplit.near_hashes(crosssplit.image_rows(images()), 13)


def test_tiles_across_splits(images, spark):
    rng = random.Random(5)
    rows, seps = [], ["data/tiles/fig_{f}{p}_tile_y{y}_x{x}.png", "data\\tiles\\FIG_{f}{p}-tile-y{y}-x{x} (1).PNG", "x//fig_{f}{p}_tile_x{x}_y{y}_copy.tif"]
    for i in range(150):
        f, p, y, x = rng.choice("ab"), rng.choice(["", "_panel_a", "_panel_b"]), rng.choice([0, 448, 460, 900, 1024, 1500]), rng.choice([0, 200, 448, 1000])
        rows.append((i, rng.choice(seps).format(f=f, p=p, y=y, x=x), rng.choice(["train", "val", None]), str(rng.choice([512, 300, 0])), rng.choice(["512", "2100", "n/a", None]), "p", f, p, y, x))
    rows.append((500, None, "train", "1", "1", "p", "", "", 0, 0))
    df = spark.createDataFrame([r[:6] + ("c", 1) for r in rows], "tile_no long, tile_path string, split string, width string, height string, source_pdf string, figure string, cy int")

    def size(v):
        return int(v) if v and v.isdigit() and int(v) > 0 else None

    def pair(a, b):
        if a[6:8] != b[6:8] or not a[1] or not b[1] or {a[2], b[2]} != {"train", "val"} or None in (size(a[3]), size(a[4]), size(b[3]), size(b[4])):
            return False
        (wa, ha), (wb, hb) = (size(a[3]), size(a[4])), (size(b[3]), size(b[4]))
        dy, dx = min(a[8] + ha, b[8] + hb) - max(a[8], b[8]), min(a[9] + wa, b[9] + wb) - max(a[9], b[9])
        return dy > 0 and dx > 0 and 2 * dy * dx >= min(wa * ha, wb * hb)

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and pair(a, b)}
    got = [(r.key_a, r.key_b) for r in crosssplit.found(images(), df).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_pivots_bound_the_distance(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        a = _hash(rng)
        b = _flip(a, rng.randrange(0, 200), rng)
        rows.append((a, b, _ham(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    wa, wb = bits.words(F.col("a")), bits.words(F.col("b"))
    out = df.select("d", bits.distance(wa, wb).alias("x"), bits.pivot_bound(bits.pivot_distances(wa), bits.pivot_distances(wb)).alias("lo")).collect()
    assert all(r.x == r.d and r.lo <= r.d for r in out) and any(r.lo > 0 for r in out)


def _url(u):
    return "a" if u and ("b=1" in u) else u


def _known(history_rows, batch_rows):
    """record_no of known rows by comparing all pairs."""
    out, before = set(), [r for r in history_rows if (r["curation_status"] or "").strip().lower() == "accepted"]
    for r in sorted(batch_rows, key=lambda r: (r["batch_no"], r["record_no"])):
        for o in before:
            same_id = (r["image_id"] or "").strip().lower() not in ("",) and (r["image_id"] or "").strip().lower() == (o["image_id"] or "").strip().lower()
            if _same_image(r, o) or same_id or (r["source_url"] and _url(r["source_url"]) == _url(o["source_url"])):
                out.add(r["record_no"])
                break
        before.append(r)
    return out


def test_history(images, spark, tmp_path):
    old, new = _rows(60, 11), [r | {"record_no": 1000 + r["row_no"], "batch_no": 1 + (r["row_no"] * 7) % 5} for r in _rows(80, 12)]
    ddl = "record_no long, batch_no int, image_id string, source_url string, file_sha256 string, ahash string, lo string, way string"
    frame = lambda rows: spark.createDataFrame([(r["record_no"], r["batch_no"], r["image_id"], r["source_url"], r["file_sha256"], r["ahash"], "c", "c") for r in rows], ddl)
    want = _known(old, new)
    got = [r.record_no for r in history.found(images(*old), frame(new)).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert history.found(images(), frame(new)).count() == len(_known([], new))
    assert history.found(images(*old), frame([])).count() == 0
    # Batch by batch against the appended tables gives the same.
    h = history.History(spark, str(tmp_path))
    h.append(history.accepted(images(*old)), "0")
    each = set()
    for b in range(1, 6):
        batch = history.incoming(frame([r for r in new if r["batch_no"] == b]))
        each |= {r.record_no for r in h.known(batch).collect()}
        h.append(batch, str(b))
    assert each == want


def test_crowded_runs_are_cut_finer_and_lose_nothing(images, monkeypatch):
    """Hashes that share most of their blocks, as pictures with plain parts do."""
    rng = random.Random(3)
    base = _hash(rng)
    rows = []
    for i in range(160):
        h = base[:40] + _hash(rng)[40:] if i % 2 else _flip(base, rng.randrange(0, 16), rng)
        rows.append({"row_no": i, "split": rng.choice(["train", "val", "test"]), "ahash": h})
    want = {(a["row_no"], b["row_no"]) for a in rows for b in rows if a["row_no"] < b["row_no"] and (a["split"] == "train") != (b["split"] == "train") and _ham(a["ahash"], b["ahash"]) <= 12}
    for run in (4096, 0):
        monkeypatch.setattr(crosssplit, "RUN", run)
        got = [(r.key_a, r.key_b) for r in crosssplit.image_overlaps(images(*rows)).select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
    near = crosssplit.near_hashes(crosssplit.image_rows(images(*rows))).collect()
    assert near and all(r["prefix"] >= 25 and r["spans"] >= 2 for r in near)


def test_a_small_batch_reads_only_its_key_ranges(images, spark, tmp_path):
    old = _rows(200, 21)
    h = history.History(spark, str(tmp_path))
    assert h.known(history.incoming(spark.createDataFrame([], "record_no long, batch_no int, image_id string, source_url string, file_sha256 string, ahash string"))).count() == 0
    h.append(history.accepted(images(*old)), "0")
    one = spark.createDataFrame([(_hash(random.Random(1)),)], "hash string")
    mine = crosssplit.suffixes(one)
    part = h.stored("pivots", mine)
    assert "slot" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert 0 < part.count() < h.stored("pivots").count()
