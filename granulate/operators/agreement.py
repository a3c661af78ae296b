"""Agreement of measured with reference values: pairing, metrics, strata, release gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions.geometry import finite
from granulate.functions.text import filled
from granulate.session import cut

# Release-gate limits in percent, and statuses that exclude a row.
LIMITS = {"diameter": (10.0, 5.0), "core": (15.0, 7.5), "outer": (10.0, 5.0), "shell": (20.0, 10.0)}
EXCLUDING = ("ambiguous", "excluded", "unresolved")


def merge_tables(reference: DataFrame, measured: DataFrame, keys: list[str], order: str, optional: list[str]) -> DataFrame:
    """Full outer join on trimmed keys; of repeated keys the last row by `order` counts.

    Value columns get the prefixes reference_ and measured_; optional text is
    taken from the reference if it has a row. A NULL key counts as blank.
    """

    def last(df: DataFrame) -> DataFrame:
        t = df.withColumns({k: F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys})
        rest = [c for c in t.columns if c not in keys]
        return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))

    a, b = last(reference), last(measured)
    values = lambda df: [c for c in df.columns if c not in [*keys, *optional, order]]
    j = a.withColumnRenamed("r", "ref").join(b.withColumnRenamed("r", "mea"), keys, "full")
    return j.select(
        *keys,
        *[F.trim(F.coalesce(F.when(F.col("ref").isNotNull(), F.col(f"ref.{c}")).otherwise(F.col(f"mea.{c}")), F.lit(""))).alias(c) for c in optional],
        *[finite(F.col(f"ref.{c}").cast("double")).alias(f"reference_{c}") for c in values(reference)],
        *[finite(F.col(f"mea.{c}").cast("double")).alias(f"measured_{c}") for c in values(measured)],
    )


def melt(table: DataFrame, quantities: list[str], keep: list[str]) -> DataFrame:
    """Long form: keep, quantity, ref, mea."""
    rows = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(f"reference_{q}").alias("ref"), F.col(f"measured_{q}").alias("mea")) for q in quantities])
    return table.select(*keep, F.explode(rows).alias("q")).select(*keep, "q.*")


def verdict(ref: Column, mea: Column, status: Column) -> Column:
    """matched, or why a row cannot be compared; NULL if the quantity does not apply."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(ref.isNull() & mea.isNull(), F.lit(None).cast("string"))
        .when(ref.isNull(), "no_reference_value")
        .when(mea.isNull(), "missed_particle")
        .when(s.isin(*EXCLUDING), F.concat(F.lit("flagged_"), s))
        .otherwise("matched")
    )


def classified(long: DataFrame) -> DataFrame:
    """Long form with the verdict of every row the quantity applies to."""
    return long.withColumn("reason", verdict(F.col("ref"), F.col("mea"), F.col("status"))).where("reason is not null")


def unmatched(long: DataFrame) -> DataFrame:
    """Rows that could not be compared, with the reason."""
    return classified(long).where("reason != 'matched'")


def pair_columns(rows: DataFrame) -> DataFrame:
    """Classified rows with r and m, the values of matched pairs, and d, e, q: difference, its size, relative error."""
    hit = F.col("reason") == "matched"
    return rows.withColumns({"r": F.when(hit, F.col("ref")), "m": F.when(hit, F.col("mea"))}).withColumns(
        {"d": F.col("m") - F.col("r"), "e": F.abs(F.col("m") - F.col("r")), "q": F.try_divide(F.abs(F.col("m") - F.col("r")), F.nullif("r", F.lit(0.0)))}
    )


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of each group in one aggregate over plain columns; undefined ones are NULL. rows: see pair_columns."""
    base = rows.groupBy(*by).agg(
        F.count("r").alias("n_"), F.avg("r").alias("rm"), F.avg("m").alias("mm"), F.avg("e").alias("ae"), F.avg(F.col("d") * F.col("d")).alias("sq"),
        F.avg("d").alias("bd"), F.min("r").alias("r0"), F.avg("q").alias("rel"), F.var_pop("r").alias("rv"), F.var_pop("m").alias("mv"),
        F.covar_pop("r", "m").alias("cv"), F.stddev_samp("d").alias("sd"), F.count("ref").alias("refs"), F.count("mea").alias("meas"),
        F.count_if(F.col("reason").startswith("flagged_")).alias("flagged"),
    )
    n, c = F.col("n_"), F.col
    two = lambda x: F.when(n >= 2, x)
    safe = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    sd = F.coalesce("sd", F.lit(0.0))
    return base.select(
        *by,
        F.when(n >= 2, n).otherwise(F.lit(0)).cast("long").alias("n"),
        two(c("rm")).alias("reference_mean"), two(c("mm")).alias("measured_mean"),
        two(c("ae")).alias("mae"), two(100 * safe(c("ae"), c("rm"))).alias("mae_percent"),
        two(F.sqrt("sq")).alias("rmse"), two(c("bd")).alias("mean_bias"), two(100 * safe(c("bd"), c("rm"))).alias("bias_percent"),
        two(F.when(c("r0") > 0, c("rel"))).alias("mean_relative_error"),
        two(F.when(c("rv") > 0, 1 - safe(c("sq"), c("rv")))).alias("r_squared_identity"),
        two(F.when((c("rv") > 0) & (c("mv") > 0), safe(c("cv"), F.sqrt(c("rv") * c("mv"))))).alias("pearson_r"),
        two(c("bd") - 1.96 * sd).alias("limit_low"), two(c("bd") + 1.96 * sd).alias("limit_high"),
        c("refs").alias("reference_particles"), c("meas").alias("measured_particles"), n.alias("matched_particles"),
        (c("refs") - n).alias("missed"), (c("meas") - n).alias("extra"), "flagged",
        F.try_divide(n, c("refs")).alias("recall"), F.try_divide(n, c("meas")).alias("precision"), F.try_divide(c("meas"), c("refs")).alias("count_ratio"),
    )


def report(long: DataFrame, strata: list[str], quantities: list[str], digits: int = 6) -> DataFrame:
    """One row per stratum, value and quantity: overall, and each stratum column with at least two values.

    Cells without rows are given with n = 0. Blank strata are `unspecified`.
    One pass over the data: rows are spread to their strata before one
    aggregate, whose groups are few.
    """
    spread = F.array(
        F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value")),
        *[F.struct(F.lit(s).alias("stratum"), F.coalesce(filled(F.col(s)), F.lit("unspecified")).alias("value")) for s in strata],
    )
    rows = pair_columns(long.withColumn("reason", verdict(F.col("ref"), F.col("mea"), F.col("status")))).select(
        "quantity", "ref", "mea", "reason", "r", "m", "d", "e", "q", F.explode(spread).alias("g")
    ).select("quantity", "ref", "mea", "reason", "r", "m", "d", "e", "q", "g.stratum", "g.value")
    per = cut(metrics(rows, ["stratum", "value", "quantity"]))  # a few rows, read twice below
    w = Window.partitionBy("stratum")
    cells = per.select("stratum", "value").distinct()
    cells = cells.withColumn("k", F.count("*").over(w)).where("stratum = 'overall' or k >= 2").drop("k")
    grid = cells.select("*", F.explode(F.array(*[F.lit(q) for q in quantities])).alias("quantity"))
    out = grid.join(per, ["stratum", "value", "quantity"], "left")
    zero = ["n", "reference_particles", "measured_particles", "matched_particles", "missed", "extra", "flagged"]
    real = [c for c in per.columns if c not in zero and c not in ("stratum", "value", "quantity")]
    return gate(out.select("stratum", "value", "quantity", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero], *[F.round(c, digits).alias(c) for c in real]))


def gate(metrics: DataFrame) -> DataFrame:
    """Adds target_pass: MAE and absolute bias within the limits of the quantity; NULL without limits or metrics."""
    cond = reduce(
        lambda acc, q: acc.when(F.col("quantity") == q[0], (F.col("mae_percent") <= q[1][0]) & (F.abs("bias_percent") <= q[1][1])),
        list(LIMITS.items())[1:],
        F.when(F.col("quantity") == "diameter", (F.col("mae_percent") <= LIMITS["diameter"][0]) & (F.abs("bias_percent") <= LIMITS["diameter"][1])),
    )
    return metrics.withColumn("target_pass", F.when(F.col("mae_percent").isNotNull(), cond))


def bland_altman_points(long: DataFrame, keep: list[str]) -> DataFrame:
    """keep, mean and difference of each pair."""
    return classified(long).where("reason = 'matched'").select(
        *keep, ((F.col("ref") + F.col("mea")) / 2).alias("pair_mean"), (F.col("mea") - F.col("ref")).alias("difference")
    )


def error_points(long: DataFrame, keep: list[str]) -> DataFrame:
    """keep, reference value, absolute error of each pair."""
    return classified(long).where("reason = 'matched'").select(*keep, "ref", F.abs(F.col("mea") - F.col("ref")).alias("abs_error"))


def reasons(long: DataFrame, by: list[str]) -> DataFrame:
    """Tally of reasons."""
    return unmatched(long).groupBy(*by, "reason").agg(F.count("*").alias("n_rows"))


def undefined(report_: DataFrame) -> DataFrame:
    """`report_` with `undefined`, a map from each metric that has no value to the reason."""
    few = F.col("n") == 0
    why = {
        "mean_relative_error": "a reference value is not positive", "r_squared_identity": "the reference values do not vary",
        "pearson_r": "one of the series does not vary", "mae_percent": "the mean reference is zero", "bias_percent": "the mean reference is zero",
    }
    entries = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("k"), F.when(few, "fewer than two pairs").otherwise(r).alias("v"))) for c, r in why.items()]
    return report_.withColumn("undefined", F.map_from_entries(F.array_compact(F.array(*entries))))


def write_report(long: DataFrame, strata: list[str], quantities: list[str], path: str, title: str = "Agreement") -> DataFrame:
    """The report as files below `path` (metrics as CSV and JSON lines, pairs with their verdict as CSV, a Markdown summary); returns it.

    The summary lists the overall rows only, one a quantity.
    """
    from granulate.sources import sinks

    rep = cut(undefined(report(long, strata, quantities)))
    flat = rep.withColumn("undefined", F.concat_ws("; ", F.transform(F.map_entries("undefined"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))))
    sinks.write_csv(flat, f"{path}/metrics", one=True)
    sinks.write_json(rep, f"{path}/report")
    sinks.write_csv(classified(long), f"{path}/pairs")
    shown = ["quantity", "n", "mae_percent", "bias_percent", "r_squared_identity", "pearson_r", "recall", "precision"]
    text = sinks.markdown(rep.where("stratum = 'overall'").orderBy("quantity").collect(), shown, title)
    long.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return rep
