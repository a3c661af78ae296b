"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer. Documents are counted by exact token
length; the budget of a source is met by whole repeats, a share of every length,
and a bounded-knapsack fit of the rest over the lengths left, in coarser units
while long documents have to fill it. Seeded hashes decide which documents of a
length are taken.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions.normalise import ident
from granulate.session import cut, spread

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUCKETS = 1024  # seeded hash buckets a length is cut into, so no length is sorted in one task
FIT = 1 << 15  # tokens of the rest that the knapsack fits exactly; more are fitted in units of 1 / FIT of them
FEW = 15  # documents whose sums (at most FIT) are all tried, whatever their lengths
LONG = 1 << 13  # characters tokenized at once, and on to the next place where every token ends
ENDS = re.compile(r"(?<=\S)\s")  # no token of PATTERN goes on from text to white space


def source_name(c):
    """One spelling of a source: lower case, joined by underscores; missing is `unknown`."""
    return F.coalesce(F.regexp_replace(ident(c), r"[\s-]+", "_"), F.lit("unknown"))


def token_counts(docs: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """doc_id, source, tokens (0 for a NULL or empty text); rows without an id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def count(text: str | None) -> int:
            total, at = 0, 0
            text = text or ""
            while at < len(text):
                m = ENDS.search(text, at + LONG)
                end = m.start() if m else len(text)
                total += len(enc.encode_ordinary(text[at:end].encode("utf-8", "replace").decode("utf-8")))
                at = end
            return total

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [count(t) for t in pdf["text"]]})

    return spread(docs.select("doc_id", "source", "text")).select("doc_id", source_name(F.col("source")).alias("source"), "text").where("doc_id is not null").mapInPandas(
        run, "doc_id long, source string, tokens long"
    )


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Number of documents by length whose total is as close below `budget` as can be."""
    made: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}  # total -> (length, number, total before)
    for length, have in sorted(counts.items(), reverse=True):
        if not 0 < length <= budget:
            continue
        used = {}
        for t in sorted(made):
            used.setdefault(t, 0)
            if used[t] < have and t + length <= budget and t + length not in made:
                made[t + length] = (length, 1, t)
                used[t + length] = used[t] + 1
        frontier = [t for t in used if t in made]
        while frontier:
            nxt = []
            for t in frontier:
                if used.get(t, 0) and used[t] < have and t + length <= budget and t + length not in made:
                    made[t + length] = (length, 1, t)
                    used[t + length] = used[t] + 1
                    nxt.append(t + length)
            frontier = nxt
        if budget in made:
            break
    take: dict[int, int] = {}
    at = max(made)
    while at:
        length, n, before = made[at]
        take[length] = take.get(length, 0) + n
        at = before
    return take


def fit_long(base: DataFrame, missing: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """`base` with more taken for sources that miss over FIT tokens and have longer documents to spare, and what is missing then.

    Lengths are counted in units of 1 / FIT of what is missing, rounded up, so a
    source has at most FIT sizes however many documents; the next round fits what
    the rounding left. It ends when no long document fits any more.
    """
    spark, missing = base.sparkSession, dict(missing)
    spare = F.col("n") - F.col("take")
    while over := [(s, m) for s, m in missing.items() if m > FIT]:
        open_ = base.where("take < n").join(F.broadcast(spark.createDataFrame(over, "source string, missing long")), "source").where("tokens <= missing")
        fits = open_.groupBy("source").agg(F.sum(spare).alias("docs"), F.max("tokens").alias("longest")).where(F.col("longest") > FIT).collect()
        if not fits:
            break
        units = {r["source"]: 1 if r["docs"] <= FEW else -(-missing[r["source"]] // FIT) for r in fits}
        sized = open_.join(F.broadcast(spark.createDataFrame(list(units.items()), "source string, unit long")), "source").withColumn("size", F.expr("(tokens + unit - 1) div unit"))
        # Of much that is missing the last documents are left to a round of finer units.
        aims = {r["source"]: missing[r["source"]] - (FEW * r["longest"] if missing[r["source"]] > 2 * FEW * r["longest"] else 0) for r in fits}
        counts: dict[str, dict[int, int]] = {}
        for r in sized.groupBy("source", "size").agg(F.sum(spare).alias("k")).collect():
            counts.setdefault(r["source"], {})[r["size"]] = r["k"]
        # Where rounding up leaves no size that fits, the longest document still does.
        picks = [(s, size, k) for s, u in units.items() for size, k in (knapsack(counts[s], aims[s] // u) or {max(counts[s]): 1}).items()]
        upto = F.sum(spare).over(Window.partitionBy("source", "size").orderBy(F.desc("tokens")))
        more = sized.join(F.broadcast(spark.createDataFrame(picks, "source string, size long, k long")), ["source", "size"]).select(
            "source", "tokens", F.greatest(F.lit(0), F.least(spare, F.col("k") - upto + spare)).alias("more")
        ).where("more > 0")
        more = cut(more)
        for r in more.groupBy("source").agg(F.sum(F.col("tokens") * F.col("more")).alias("t")).collect():
            missing[r["source"]] -= r["t"]
        base = cut(base.join(more, ["source", "tokens"], "left").select("source", "tokens", "n", (F.col("take") + F.coalesce("more", F.lit(0))).alias("take")))
    return base, missing


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(source, tokens, take) table of extra documents by length, and the plan of each source.

    Without `total` the largest one is used at which every target source that
    has documents can be met within its cap. A source without documents, with a
    blank name, share or cap gives nothing; sources without a target are left out.
    """
    want = {
        r["source"]: (r["share"], r["cap"])
        for r in targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).collect()
        if r["share"] and r["share"] > 0 and r["cap"] and r["cap"] > 0
    }
    have = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).where(F.col("source").isin(list(want))).collect()}
    met = {s: w for s, w in want.items() if have.get(s)}
    if total is None:
        total = int(min((have[s] * cap / share for s, (share, cap) in met.items()), default=0))
    plans = []
    lengths = sizes.where((F.col("tokens") > 0) & F.col("source").isin(list(met))).groupBy("source", "tokens").agg(F.count("*").alias("n"))
    by_source: dict[str, dict[int, int]] = {}
    for s, (share, cap) in met.items():
        budget = min(int(share * total), have[s] * cap)
        whole, rest = divmod(budget, have[s])
        plans.append({"source": s, "budget": budget, "repeats": whole, "rest": rest, "have": have[s]})
    # A share of every length first; what then is missing is less than one document a length.
    spark = sizes.sparkSession
    shares = spark.createDataFrame([(p["source"], p["rest"] / p["have"]) for p in plans] or [("", 0.0)], "source string, f double")
    base = cut(lengths.join(F.broadcast(shares), "source").select("source", "tokens", "n", F.floor(F.col("n") * F.col("f")).alias("take")))
    got = {r["source"]: r["t"] for r in base.groupBy("source").agg(F.sum(F.col("tokens") * F.col("take")).alias("t")).collect()}
    base, lacks = fit_long(base, {p["source"]: p["rest"] - got.get(p["source"], 0) for p in plans})
    # Lengths the rest is fitted from: at most FIT rows a target source. No longer document fits what is missing.
    spare: dict[str, dict[int, int]] = {}
    for r in base.where((F.col("take") < F.col("n")) & (F.col("tokens") <= FIT)).collect():
        spare.setdefault(r["source"], {})[r["tokens"]] = r["n"] - r["take"]
    for p in plans:
        missing, free = lacks[p["source"]], spare.get(p["source"], {})
        mine = by_source.setdefault(p["source"], {})
        for length in sorted(free, reverse=True):
            n = min(free[length], max(0, missing - FIT // 2) // length) if missing > FIT else 0
            if n:
                mine[length] = n
                missing -= n * length
        left = {k: n - mine.get(k, 0) for k, n in free.items() if n > mine.get(k, 0)}
        for length, n in knapsack(left, min(missing, FIT)).items():
            mine[length] = mine.get(length, 0) + n
    extra = [(s, length, n) for s, d in by_source.items() for length, n in d.items()]
    more = spark.createDataFrame(extra or [("", -1, 0)], "source string, tokens long, more long")
    take = base.join(more, ["source", "tokens"], "left").select("source", "tokens", (F.col("take") + F.coalesce("more", F.lit(0))).alias("take"))
    return take.where("take > 0"), plans


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: str = "42", ranks_file: str = RANKS_FILE) -> DataFrame:
    """doc_id, source, tokens, repeats (at least 1) of the chosen documents.

    doc_id must be unique. Documents of no tokens are never chosen.
    """
    sizes = cut(token_counts(docs, ranks_file))
    take, plans = plan(sizes, targets, total)
    spark = docs.sparkSession
    whole = spark.createDataFrame([(p["source"], p["repeats"]) for p in plans] or [("", 0)], "source string, whole int")
    seeded = sizes.where("tokens > 0").join(F.broadcast(whole), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    seeded = seeded.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    # Buckets are taken whole while they fit; only the last one of a length is sorted.
    per = seeded.groupBy("source", "tokens", "bucket").agg(F.count("*").alias("n")).join(take, ["source", "tokens"])
    w = Window.partitionBy("source", "tokens").orderBy("bucket")
    upto = F.sum("n").over(w)
    quota = per.select("source", "tokens", "bucket", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - upto + F.col("n"))).alias("quota"), "n").where("quota > 0")
    chosen = seeded.join(quota, ["source", "tokens", "bucket"], "left")
    full = chosen.where("quota is null or quota = n").withColumn("extra", F.when(F.col("quota").isNotNull(), 1).otherwise(0))
    part = chosen.where("quota < n").withColumn(
        "extra", (F.row_number().over(Window.partitionBy("source", "tokens", "bucket").orderBy("h", "doc_id")) <= F.col("quota")).cast("int")
    )
    cols = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")]
    return full.select(*cols).unionByName(part.select(*cols)).where("repeats > 0")


def shares(docs: DataFrame, targets: DataFrame, total: int | None = None, ranks_file: str = RANKS_FILE) -> DataFrame:
    """Per target source: documents and tokens chosen, target_share, actual_share, largest repeat; 0 for sources without documents."""
    per = mix(docs, targets, total, ranks_file=ranks_file).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    whole = per.agg(F.sum("n_tokens").alias("all_tokens"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    return want.join(per, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
