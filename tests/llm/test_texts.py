"""Problems 7, 8 and 9."""

import math
import random

import numpy as np
import pytest
from granulate.llm import leakage, mixture, quality, textform
from pyspark.sql import functions as F


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "test", "k", 1) for i, t in rows], "item_id long, text string, split string, kind string, block int")


def test_words():
    assert leakage.words("<b>Ca\xadfé</b> ﬁne\n> x_1&amp;2 5.3") == ["café", "fine", "x", "1", "2", "5", "3"]
    assert leakage.words(None) == leakage.words("") == []


def test_leaks_match_brute_force(spark, docs):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 30])))) for i in range(20)]
    texts = []
    for d in range(60):
        parts = [rng.choice(vocab) for _ in range(20)]
        src = rng.choice(items)[1].split()
        n = rng.choice([8, 11, 12, 13, 30])
        a = rng.randrange(0, max(1, len(src) - n + 1))
        texts.append((d, " ".join(parts) + ".\n> " + ", ".join(w.upper() for w in src[a : a + n]) + " <i>end</i>", "en", "s"))
    texts += [(900, None, None, None), (901, "", "en", "s"), (None, items[-1][1], "en", "s"), (902, "word " * 200000 + items[2][1], "en", "s")]

    def grams(t):
        w = leakage.words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t, *_ in texts if d is not None for i, s in items if grams(t) & grams(s)}
    got = [(r.doc_id, r.item_id) for r in leakage.found(docs(*texts), _items(spark, items)).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert leakage.found(docs(*texts), _items(spark, [])).count() == 0 and leakage.found(docs(), _items(spark, items)).count() == 0


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for r in (1, 2, 3):
        b = a.copy()
        for _ in range(r):
            b ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
        assert (np.array([x == y for x, y in zip(leakage.blocks(a, r), leakage.blocks(b, r), strict=True)]).any(axis=0)).all()


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for window in (1, 5, 12, 16, 31):
        want = [sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h[i : i + window]) > window // 2) for i in range(len(h) - window + 1)]
        # Bytes of a hash are unpacked in memory order, so only the places of the bits differ.
        got = [int.from_bytes(int(x).to_bytes(8, "little"), "little") for x in leakage.fingerprints(h, window)]
        assert got == want


def test_windows_are_verified_by_their_shingles(spark, docs):
    text = " ".join(f"t{i}" for i in range(40))
    w = text.split()
    shuffled = " ".join([*w[6:12], *w[:6]])  # the words of a window in another order: the same fingerprint
    near = " ".join(w[:39] + ["other"])
    rows = [(1, text, "en", "s"), (2, "x " * 30, "en", "s"), (3, shuffled, "en", "s"), (4, f"{shuffled} and {' '.join(w[:12])}", "en", "s"), (5, f"so {near} end", "en", "s")]
    got = {r.doc_id: (r.leaked, r.similarity) for r in leakage.leaks(docs(*rows), _items(spark, [(5, text)])).collect()}
    assert got.keys() == {1, 4, 5} and got[1] == (40, 1.0) and got[4][0] == 12 and got[4][1] < 0.8 and got[5][0] == 39 and 0.8 <= got[5][1] < 1
    assert [tuple(r) for r in leakage.leaked_items(docs(*rows), _items(spark, [(5, text)])).select("n_docs", "near_copies").collect()] == [(3, 2)]
    assert leakage.verified(w, w, [(0, 3)]) is None and leakage.verified(w, w, [(3, 3)]) == 1.0


def test_near_copies_hold_a_window():
    """Five-word shingles 0.8 alike leave 12 equal words in a row, whatever words are changed."""
    rng = random.Random(7)
    for _ in range(3000):
        item = [f"w{i}" for i in range(rng.randrange(12, 90))]
        copy = [rng.choice(["x", w]) if rng.random() < 0.06 else w for w in item]
        if leakage.similarity(copy, item) >= leakage.SIMILARITY:
            assert leakage.passages(copy, item) >= 12


def test_knapsack():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        budget = rng.randrange(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        take = mixture.knapsack(counts, budget)
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= budget) and all(n <= counts[k] for k, n in take.items())


def test_mix(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["gold", "rod", "in", "water"]) for _ in range(rng.randrange(5, 60))), "en", rng.choice(["a", "A", "b", " B", "c", None])) for i in range(300)]
    rows += [(900, None, "en", "a"), (901, "", "en", "b"), (None, "x", "en", "a")]
    targets = spark.createDataFrame([("a", 0.6, 1, 1), ("b", 0.35, 3, 1), ("absent", 0.05, 2, 1), (None, None, None, 1)], "source string, target_share double, max_repeats int, tokens int")
    out = mixture.mix(docs(*rows), targets).collect()
    assert len({r.doc_id for r in out}) == len(out) and all(1 <= r.repeats <= {"a": 1, "b": 3}[r.source] for r in out) and not {900, 901} & {r.doc_id for r in out}
    total = {s: sum(r.tokens * r.repeats for r in out if r.source == s) for s in "ab"}
    assert abs(total["a"] / total["b"] - 0.6 / 0.35) < 0.01
    shares = {r.source: r for r in mixture.shares(docs(*rows), targets).collect()}
    assert shares["absent"].n_docs == 0 and shares["absent"].actual_share == 0 and abs(shares["a"].actual_share - 0.6 / 0.95) < 0.01
    assert mixture.mix(docs(), targets).count() == 0 and mixture.mix(docs(*rows), targets.limit(0)).count() == 0
    again = {(r.doc_id, r.repeats) for r in mixture.mix(docs(*rows), targets).collect()}
    assert again == {(r.doc_id, r.repeats) for r in out}


def test_long_documents_fill_the_rest(spark):
    """Lengths that occur once have no share of their own; the fit takes them whole, next to short ones and alone."""
    rng = random.Random(8)
    have = {
        "ten": [rng.randrange(90_000, 110_000) for _ in range(10)], "halves": [60_000, 50_001, 50_001], "one": [200_000, 100_000],
        "many": [rng.randrange(40_000, 200_000) for _ in range(300)], "mixed": [rng.randrange(40_000, 200_000) for _ in range(40)] + [rng.randrange(5, 900) for _ in range(400)],
    }
    rests = {"ten": 0.55, "halves": 100_002 / 160_002, "one": 1 / 3, "many": 0.4, "mixed": 0.7}
    sizes = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in have.items() for n in ns)], "doc_id long, source string, tokens long")
    for s, f in rests.items():
        rest = round(sum(have[s]) * f)
        targets = spark.createDataFrame([(s, 1.0, 1)], "source string, target_share double, max_repeats int")
        take, plans = mixture.plan(sizes, targets, rest)
        got = [(r.tokens, r["take"]) for r in take.collect()]
        assert plans[0]["rest"] == rest and all(k <= have[s].count(n) for n, k in got)
        total = sum(n * k for n, k in got)
        if len(have[s]) <= 10:
            sums = {0}
            for n in have[s]:
                sums |= {t + n for t in sums}
            assert total == max(t for t in sums if t <= rest), s
        else:
            assert rest - (0 if s == "mixed" else 0.001 * rest) <= total <= rest, s


PROSE = "The rods were washed in water and dried before imaging. We counted the particles that lay in the frame, and the rest was left out."
FORMS = {
    "prose": [PROSE, PROSE.lower().replace(".", "").replace(",", ""), PROSE.replace(" in ", "\nin "), "Die Proben wurden gewaschen und bei 40 °C getrocknet, weil die Hülle nicht dicht war.", PROSE + "\n- gold rods\n- silver cubes", PROSE * 3 + "\na,1,2\nb,3,4\nc,5,6"],
    "list": ["\n".join(f"- {m} rods" for m in ("gold", "silver", "ceria", "nickel", "iron")), "\n".join(f"core diameter: {i} nm" for i in range(6)), "gold rods, silver cubes, ceria plates, core diameter, 3 nm, nickel rods, iron cubes, shell width, gold wires", "\n".join(f"Chapter {i} ........ {i}" for i in range(6))],
    "table": ["name,a,b\nx,1.0,2\ny,3,4\nz,5,6", "\n".join(f"| s{i} | {i} | 7 |" for i in range(5)), "\n".join(f"<tr><td>s{i}</td><td>{i}</td></tr>" for i in range(4)), "\n".join(f"s{i}\t{i}\t{i + 1}" for i in range(4))],
    "junk": ["Menu\nHome\nSearch\nLog in\nSubscribe\nCite\nShare", "gold " * 60, "%;57!^]<1#!>^}&# ]52*60[}*:#*/!#$|96.5=]69&@6/", "A1b2C3d4E5f6" * 20, "0x77e47f55 DBG 0xa0ff rc=254\n0x9de8f9d8 TRC 0x8fed rc=27"],
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    assert [textform.statistics(t)["form"] for t in FORMS[form]] == [form] * len(FORMS[form])


def test_found_forms(docs):
    rows = [(i, PROSE + f" It was run {i} of the day, {'and ' * (i % 5)}the film held." * (1 + i % 4), "en" if i % 3 else " EN", "s") for i in range(200)]
    odd = [(1000 + i, t, "en", "s") for i, t in enumerate(FORMS["list"] + FORMS["table"] + FORMS["junk"])]
    odd += [(2000, None, None, "s"), (2001, "", "en", "s"), (None, "x", "en", "s"), (2002, "." * 200000, "en", "s")]
    got = {r.doc_id: r.form for r in quality.found(docs(*rows, *odd)).collect()}
    want = {1000 + i: f for i, f in enumerate(["list"] * 4 + ["table"] * 4 + ["junk"] * 5)}
    assert {k: v for k, v in got.items() if k < 2000} == want
    assert quality.found(docs()).count() == 0


def test_found_forms_that_many_share(docs):
    """Copies of one junk text on a third of the rows, a language without prose and one of a single document are all named."""
    rows = [(i, PROSE + f" It was run {i} of the day.", "en", "s") for i in range(120)]
    junk = [(1000 + i, FORMS["junk"][0], "en", "s") for i in range(60)]
    tables = [(2000 + i, FORMS["table"][0], "nl", "s") for i in range(60)]
    one = [(3000, FORMS["list"][0], "fr", "s"), (3001, "", "en", "s"), (3002, None, "en", "s")]
    got = {r.doc_id: r.form for r in quality.found(docs(*rows, *junk, *tables, *one)).collect()}
    assert got == {d: "junk" for d, *_ in junk} | {d: "table" for d, *_ in tables} | {3000: "list", 3001: "junk", 3002: "junk"}
    assert {r.doc_id: r.form for r in quality.found(docs(one[0])).collect()} == {3000: "list"}


def test_ranks_are_exact(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice("xy"), float(rng.choice([0, 0, 0, rng.randrange(50)])), rng.choice([0, 1])) for _ in range(2000)]
    got = {(r.grp, r.stat, r.value): (r.upto, r.n, r.total) for r in quality.ranks(spark.createDataFrame(rows, "grp string, stat string, value double, ref int").repartition(5)).collect()}
    for g, s, v in {r[:3] for r in rows}:
        same = [x for a, b, x, ref in rows if (a, b) == (g, s) and ref]
        assert got[g, s, v] == (sum(x <= v for x in same), same.count(v), len(same))


def test_scores_are_the_tails_against_distinct_prose(docs):
    """Brute force of the score over a language of three documents, a large one, copies and other forms."""
    rng = random.Random(4)
    rows = [(i, PROSE + f" It was run {rng.randrange(9999)} of the day" + rng.choice([".", "", ", they say."]) * (i % 3), "en", "s") for i in range(80)]
    rows += [(100 + i, f"Die Proben wurden gewaschen und bei {i} °C getrocknet, weil die Hülle nicht dicht war.", "de", "s") for i in range(3)]
    rows += [(200 + i, rows[0][1], "en", "s") for i in range(40)] + [(300 + i, t, "en", "s") for i, t in enumerate(FORMS["list"] + FORMS["junk"])]
    stats = {i: textform.statistics(t) | {"lang": lang, "text": t} for i, t, lang, _ in rows}
    prose = {(s["lang"], s["text"]): s for s in stats.values() if s["form"] == "prose"}.values()

    def score(s):
        total = 0.0
        for k in quality.STATS:
            own, every = [p[k] for p in prose if p["lang"] == s["lang"]], [p[k] for p in prose]
            tail = lambda f: (sum(map(f, own)) + quality.WEIGHT * (sum(map(f, every)) + 1) / (len(every) + 1)) / (len(own) + quality.WEIGHT)  # noqa: B023, E731
            total -= math.log(min(1, 2 * min(tail(lambda x: x <= s[k]), tail(lambda x: x >= s[k]))))
        return total

    got = {r.doc_id: r for r in quality.scored(docs(*rows)).collect()}
    want = {i: score(s) for i, s in stats.items()}
    assert got.keys() == want.keys() and all(abs(got[i].score - want[i]) < 1e-5 for i in want)
    per = sorted(score(p) for p in prose)
    assert all(abs(got[i].tail - sum(x >= want[i] - 1e-6 for x in per) / len(per)) < 1e-9 for i in want)


def test_long_texts_are_counted_whole(docs):
    """Lines without a blank, a list of commas, one word and white space, each beyond what is tokenized at once."""
    import base64

    import tiktoken

    with open(mixture.RANKS_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["gold\n" * 6000, "rod,5;" * 5000, "x" * 30000, " \n " * 9000 + "end", ("gold   rods\t\n and so it's on " * 900).strip(), "rods " * 4000 + " " * 9000]
    got = {r.doc_id: r.tokens for r in mixture.token_counts(docs(*[(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
