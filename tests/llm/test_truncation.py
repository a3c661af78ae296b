import random

from granulate.llm import truncation as t


def test_left_open_and_tokens():
    cut = ["a (b", 'he said "no', "x <i>y", "fish &am", "fish &#17", "word �", "50 \\u00", "name%C", "see <b", "«a"]
    whole = ["a (b) c", 'he "said" no', "x <i>y</i>", "salt &amp; pepper", "about 48%", "(a) Panel", "5\" wide", "", "a<br>b"]
    assert all(t.left_open(x) for x in cut)
    assert not any(t.left_open(x) for x in whole)
    assert t.left_open("The rods <a href='" + "x" * 5000) and not t.left_open("a < b " + "x" * 5000)
    assert t.tokens("Sample V49, 3.5 nm") == ["Sample", "X#", ",", "#", "nm"]


def _rows():
    random.seed(1)
    heads = ["Micrograph of gold rods", "Overview of silver cubes deposited from water", "Sample of ceria plates"]
    tails = ["The scale bar corresponds to 20 nm", "Arrows mark missing cores", "Images were recorded by slow scanning"]
    rows = []
    for n in range(240):
        host = f"https://site{n % 2}.example/x"
        text = f"{random.choice(heads)}. {random.choice(tails)}." if n % 8 else f"{random.choice(heads)}. {random.choice(tails)}"
        rows.append({"row_no": n, "source_url": host, "caption": text})
    return rows


def test_found(images, sources):
    rows = _rows()
    cut = [
        {"row_no": 900, "source_url": "https://site0.example/y", "caption": "Micrograph of gold rods. The scale bar corresp"},
        {"row_no": 901, "source_url": None, "source_id": "S1 ", "caption": "Overview of silver cubes deposited from"},
        {"row_no": 902, "source_url": "https://site1.example/y", "caption": "Sample of ceria plates. Arrows mark…"},
        {"row_no": 903, "source_url": "https://site1.example/y", "caption": "Sample of ceria (plates"},
    ]
    other = [
        {"row_no": 910, "caption": None}, {"row_no": 911, "caption": "  "}, {"row_no": None, "caption": "Micrograph of"},
        {"row_no": 912, "source_url": "https://site1.example/y", "caption": "Sample of ceria plates. " * 4000},
    ]
    src = sources({"row_no": 1, "source_id": "s1", "domain": "www.Far.example", "accessed_at": "2"}, {"row_no": 2, "source_id": "s1", "domain": None, "accessed_at": "3"})
    got = {r.row_no for r in t.found(images(*rows, *cut, *other), src).collect()}
    assert got == {900, 901, 902, 903}
    share = {r.site: (r.captions, r.cut) for r in t.shares(images(*rows, *cut, *other), src).collect()}
    assert share["far.example"] == (1, 1) and share["site1.example"][1] == 2


def test_repeated_rows_and_empty(images, sources):
    rows = _rows() + [{"row_no": 950 + i, "source_url": "https://site0.example", "caption": "Micrograph of gold rods. The sca"} for i in range(3)]
    assert {r.row_no for r in t.found(images(*rows), sources()).collect()} == {950, 951, 952}
    assert t.found(images(), sources()).count() == 0


def test_field_limit(images, sources):
    """A caption at the length where cuts pile up is cut even where its words could end."""
    random.seed(2)
    rows = [{"row_no": n, "source_url": "https://a.example", "caption": f"Micrograph number {n} of many gold rods on a film. Arrows mark missing cores near the rim."} for n in range(60)]
    long = "Micrograph number 7 of many gold rods on a film. Arrows mark missing cores near the rim."
    rows += [{"row_no": 500 + n, "source_url": "https://b.example", "caption": (f"Note {'x' * (n % 7)}. " + long)[:50]} for n in range(40)]
    found = {r.row_no for r in t.found(images(*rows), sources()).collect()}
    assert found >= {500 + n for n in range(40) if not rows[60 + n]["caption"].rstrip().endswith(".")}
    assert not found & set(range(60))


def test_every_limit_of_every_site(spark):
    """Several limits a site, one of the NULL site, and more sites than a list of limits could hold."""
    rows = [(site, True, False, size, size) for site, sizes in (("a", (80, 200)), (None, (60, 90, 300))) for size in sizes for _ in range(6)]
    rows += [("a", False, True, n, n) for n in range(40, 250)] + [("a", go, False, 74, 74) for go in [True] * 5 + [False] * 30]  # a length of whole texts
    many = spark.range(5000).selectExpr("concat('s', id) site", "true goes_on", "false term", "int(50 + id % 7) chars", "int(50 + id % 7) bytes", "explode(sequence(1, 5)) k").drop("k")
    got = t.field_limits(spark.createDataFrame(rows, "site string, goes_on boolean, term boolean, chars int, bytes int").unionByName(many)).where("unit = 'chars'").collect()
    assert len(got) == 5005
    assert {(r.lsite, r["size"]) for r in got if r.lsite in ("a", None)} == {("a", 80), ("a", 200), (None, 60), (None, 90), (None, 300)}


def test_second_limit_of_a_site(images, sources):
    """After a blank a caption is cut at either limit of its site, and only there."""
    whole = [{"row_no": n, "source_url": "https://a.example", "caption": f"Micrograph number {n} of gold rods on a film. Arrows mark missing cores near the rim."} for n in range(60)]
    text = "Overview of gold rods on a film. Arrows mark missing cores near the rim. Micrograph of gold rods on a film."
    cuts = [{"row_no": 500 + n, "source_url": "https://b.example", "caption": f"Note {'x' * (n % 4)}. {text}"[:limit]} for n, limit in enumerate([60] * 40 + [100] * 30)]
    ends = [{"row_no": 700 + i, "source_url": "https://b.example", "caption": "Arrows mark missing cores near the rim".rjust(n - 1, "x") + " "} for i, n in enumerate((60, 100, 90))]
    assert {r.row_no for r in t.found(images(*whole, *cuts, *ends), sources()).where("row_no >= 700").collect()} == {700, 701}


def test_the_site_baseline_decides(images, sources, spark):
    """The same unterminated text is cut where unterminated texts are mostly cut, and whole where they are mostly whole."""
    rows, n = [], 0
    def put(site, caption, times=1):
        nonlocal n
        for _ in range(times):
            rows.append({"row_no": (n := n + 1), "source_url": f"https://{site}.example", "caption": caption})
    put("tidy", "Gold rods on a film near the rim. Arrows mark missing cores.", 60)
    put("tidy", "Gold rods on a film near the rim. Arrows mark mis", 30)
    put("loose", "Missing cores near the rim", 30)
    put("loose", "Gold rods on a film. Silver.", 8)
    first = n
    put("tidy", "Gold rods on a film")
    put("loose", "Gold rods on a film")
    why = {r.row_no: r.why for r in t.judged(t.with_site(images(*rows), sources())).where(f"row_no > {first}").collect()}
    assert why == {first + 1: "missing terminator", first + 2: None}
    marked = spark.createDataFrame([("a", True, False)] * 9 + [("a", False, True)] + [("b", False, True)] * 3 + [("b", False, False)], "at string, seems_cut boolean, seems_whole boolean")
    assert {r["at"]: r.baseline for r in t.baselines(marked).collect()} == {"a": 5.0, "b": 0.25}
