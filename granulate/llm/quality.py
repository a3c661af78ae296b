"""Problem 9: per-document text statistics, outlier scores and the form of each text.

Each statistic is ranked exactly within its language: values are counted, range
partitioned, sorted and cumulated with the offsets of the partitions before.
The distribution a value is held against is that of the distinct texts of the
language whose lines are mostly prose, so neither copies nor a language full of
lists make a form look usual. The two-sided tail probabilities of the statistics
add up to a score (-log); the score is ranked in the same way, and texts beyond
what all but OUTLYING of the prose texts reach are outliers. Their lines name them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions.normalise import ident
from granulate.llm import textform
from granulate.session import cut, spread

STATS = ["symbols", "digits", "closed_lines", "common", "mean_word", "marked"]  # ranked
FIGURES = ["words", "distinct", "sentence_words", *STATS]
WEIGHT = 50  # a language's own tail counts like its prose texts, that of all languages together like so many texts
OUTLYING = 0.005  # share of the prose texts that may score like an outlier


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_id, the figures, form, other. NULL text counts as empty; missing or unknown lang is `und`; rows without an id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([textform.statistics(t or "") for t in pdf["text"]], columns=[*FIGURES, "form", "other"])
            yield pd.concat([pdf[["doc_id", "lang", "text_id"]].reset_index(drop=True), out], axis=1)

    lang = F.coalesce(ident(F.col("lang")), F.lit("und"))
    return spread(docs.select("doc_id", "lang", "text")).select(
        "doc_id", F.when(lang.isin("unk", "unknown", "n/a", "none", "?"), "und").otherwise(lang).alias("lang"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")
    ).where("doc_id is not null").mapInPandas(run, "doc_id long, lang string, text_id long, " + ", ".join(f"{s} double" for s in FIGURES) + ", form string, other string")


def ranks(long: DataFrame) -> DataFrame:
    """grp, stat, value, n (reference rows with it), upto (those up to and with it), total: exact, without one big sort.

    `long` holds grp, stat, value and ref (1 for rows of the reference, else 0). Equal values are
    counted before the shuffle, so a value that a third of all rows share is one row here.
    """
    counted = long.groupBy("grp", "stat", "value").agg(F.sum("ref").alias("n"))

    def cumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, last, run = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(pdf["grp"], pdf["stat"], strict=True))
            sums = pdf.groupby(["grp", "stat"], sort=False)["n"].cumsum().to_numpy().copy()
            if keys[0] == last:
                sums[: next((i for i, k in enumerate(keys) if k != last), len(keys))] += run
            last, run = keys[-1], sums[-1]
            yield pdf.assign(pid=pid, upto=sums)

    # The range borders are sampled, so what they yield is kept before it is read twice.
    sorted_ = cut(
        counted.repartitionByRange("grp", "stat", "value").sortWithinPartitions("grp", "stat", "value")
        .mapInPandas(cumulate, "grp string, stat string, value double, n long, pid int, upto long")
    )
    sums = sorted_.groupBy("grp", "stat", "pid").agg(F.max("upto").alias("part"))
    w = Window.partitionBy("grp", "stat")
    offsets = sums.select(
        "grp", "stat", "pid",
        F.coalesce(F.sum("part").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("part").over(w).alias("total"),
    )
    return sorted_.join(offsets, ["grp", "stat", "pid"]).select(
        "grp", "stat", "value", "n", (F.col("upto") + F.col("before")).alias("upto"), "total"
    )


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the figures, form, other, score (sum of -log two-sided tails against prose), tail (share of the prose texts that score as high).

    Repeated rows of a document each have theirs. Where there is no prose text at all the score is 0 and the tail 0.
    """
    stats = cut(statistics(docs))
    own = ["lang", "text_id"]
    texts = cut(stats.groupBy(*own).agg(*[F.any_value(c).alias(c) for c in STATS], F.any_value("form").alias("form")))
    values = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])
    ref = (F.col("form") == "prose").cast("int")
    long = texts.select(*own, ref.alias("ref"), F.explode(values).alias("x")).select(*own, "ref", "x.*")
    # Each text is held against its language and against all languages together.
    both = long.select(*own, "ref", "stat", "value", F.explode(F.array(F.concat(F.lit("="), "lang"), F.lit("*"))).alias("grp"))
    r = ranks(both.select("grp", "stat", "value", "ref")).select("grp", "stat", "value", "upto", (F.col("total") - F.col("upto") + F.col("n")).alias("from_"), "total")
    mine = r.where("grp != '*'").select(F.substr("grp", F.lit(2)).alias("lang"), "stat", "value", *[F.col(c).alias("l_" + c) for c in ("upto", "from_", "total")])
    every = r.where("grp = '*'").select("stat", "value", *[F.col(c).alias("a_" + c) for c in ("upto", "from_", "total")])
    shrunk = lambda c: (F.col("l_" + c) + WEIGHT * (F.col("a_" + c) + 1) / (F.col("a_total") + 1)) / (F.col("l_total") + WEIGHT)
    tails = mine.join(every, ["stat", "value"]).select("lang", "stat", "value", (-F.log(F.least(F.lit(1.0), 2 * F.least(shrunk("upto"), shrunk("from_"))))).alias("t"))
    score = cut(
        long.join(tails, ["lang", "stat", "value"]).groupBy(*own).agg(F.round(F.sum("t"), 6).alias("score"), F.max("ref").alias("ref"))
    )
    rank = ranks(score.select(F.lit("*").alias("grp"), F.lit("score").alias("stat"), F.col("score").alias("value"), "ref"))
    tail = rank.select(F.col("value").alias("score"), F.coalesce(F.try_divide(F.col("total") - F.col("upto") + F.col("n"), F.col("total")), F.lit(0.0)).alias("tail"))
    return stats.join(score.drop("ref").join(tail, "score"), own).drop("text_id")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, form of documents whose text is not prose, however many others are alike.

    The ranks choose: a text is a case if its score lies beyond that of all but
    OUTLYING of the prose texts. Its lines name it; a chosen text whose lines are
    mostly prose is none. An empty or NULL text is junk. Repeated rows of a document are given once.
    """
    return scored(docs).where(F.col("tail") <= OUTLYING).where("form != 'prose'").select("doc_id", "form").distinct()


def summary(docs: DataFrame) -> DataFrame:
    """Per language and form: documents, those the ranks choose, and mean statistics."""
    return scored(docs).groupBy("lang", "form").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("tail") <= OUTLYING).alias("outliers"), *[F.round(F.avg(c), 6).alias(c) for c in [*FIGURES, "score"]]
    )
