"""Figure triage: scores, classes, runs of gutters, panels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulate.functions.geometry import clamp01
from granulate.operators.ordering import placed


def runs(df: DataFrame, by: list[str], index: str, flag: str, least: int = 8) -> DataFrame:
    """Gaps and islands: by, start, end (exclusive) of runs of true of at least `least` places.

    Places are counted over the whole order, so a group of any size spreads over
    tasks; inside a run index and place go up together. `index` is unique within a group.
    """
    hit = placed(df.where(F.col(flag)).select(*by, index), [*by, index], "_place").withColumn("g", F.col(index) - F.col("_place"))
    return hit.groupBy(*by, "g").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).where(F.col("end") - F.col("start") >= least).drop("g")


def gutter_centres(rows: DataFrame, by: list[str]) -> DataFrame:
    """Centres of white gutters of a projection (mean, spread per place) away from the borders; rows: by, i, mean, spread, length."""
    flagged = rows.withColumn("white", (F.col("mean") > 242) & (F.col("spread") < 12))
    size = rows.groupBy(*by).agg(F.max("length").alias("length"))
    r = runs(flagged, by, "i", "white", 1).join(size, by).where(F.col("end") - F.col("start") >= F.greatest(F.lit(8), F.floor(F.col("length") / 180)))
    c = F.floor((F.col("start") + F.col("end")) / 2)
    return r.select(*by, c.alias("centre"), "length").where((F.col("centre") > F.col("length") * 0.08) & (F.col("centre") < F.col("length") * 0.92)).drop("length")


def scores(f: dict[str, Column]) -> dict[str, Column]:
    """tem, graph, abstract and crowding score from the picture's features (weights are fixed values)."""
    b = lambda c: c.cast("double")
    return {
        "graph": clamp01(f["axis"] * 0.55 + f["white"] * 0.25 + f["text"] * 0.25 + b(f["lines"] >= 2) * 0.15 - f["scale"] * 0.20),
        "abstract_or_scheme": clamp01(f["color"] * 0.65 + (1 - f["texture"]) * 0.15 + f["text"] * 0.15 + f["white"] * 0.08 - f["scale"] * 0.20),
        "tem": clamp01(f["gray"] * 0.34 + f["texture"] * 0.28 + f["scale"] * 0.22 + f["edge"] * 0.18 + (1 - f["axis"]) * 0.18 - f["color"] * 0.22),
        "crowding": clamp01(f["dark"] * 2.5 + f["edge"] * 4.0 + F.greatest(F.lit(0.0), f["texture"] - 0.55) * 0.9),
    }


def top_class(tem: Column, graph: Column, abstract: Column) -> Column:
    """struct(class, confidence) by the best of three scores and its margin; unsure below 0.48, earlier classes win ties."""
    best = F.greatest(tem, graph, abstract)
    second = F.get(F.sort_array(F.array(tem, graph, abstract), asc=False), F.lit(1))
    conf = clamp01(best * 0.72 + (best - second) * 0.55)
    name = F.when(tem == best, "tem").when(graph == best, "graph").otherwise("abstract_or_scheme")
    return F.struct(F.when(conf < 0.48, "needs_review").otherwise(name).alias("class"), conf.alias("confidence"))


def row_status(cls: Column, conf: Column) -> Column:
    """What a triage row needs next."""
    return F.when((cls == "tem") & (conf >= 0.55), "auto_candidate").when(cls.isin("graph", "abstract_or_scheme") & (conf >= 0.55), "auto_rejected").otherwise("needs_review")


def typed(triage: DataFrame) -> DataFrame:
    """Triage rows with numbers and flags; unreadable ones are NULL."""
    num = ["confidence", "tem_score", "graph_score", "abstract_score", "panel_score", "crowding_score"]
    flag = ["scale_bar_detected", "is_multipanel", "is_crowded"]
    yes = lambda c: F.when(F.lower(F.trim(c)).isin("true", "false"), F.lower(F.trim(c)) == "true")
    return triage.withColumns({c: F.trim(F.col(c)).try_cast("double") for c in num} | {c: F.trim(F.col(c)).try_cast("int") for c in ("width", "height")} | {c: yes(F.col(c)) for c in flag})
