"""Distribution hints, class and object summaries, histograms and reference curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least number of values for a hint, and its cut-offs.
LEAST, SKEW, KURTOSIS = 8, 1.0, 2.0


def positive(c: Column) -> Column:
    """The value if it is a number above 0, else NULL."""
    return F.when((c > 0) & ~F.isnan(c), c)


def distribution(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """n, mean, std (population), skewness, excess kurtosis and a hint per group; values at or below 0 do not count."""
    v = positive(F.col(value).cast("double"))
    g = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew_"), F.kurtosis(v).alias("kurt_")
    )
    known = (F.col("n") >= LEAST) & (F.col("std") > 1e-9)
    return g.select(
        *by, "n", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
        F.round(F.when(known, F.col("skew_")), digits).alias("skewness"), F.round(F.when(known, F.col("kurt_")), digits).alias("kurtosis_excess"),
        F.when(F.col("n") == 0, "no data").when(~known, "insufficient_n")
        .when((F.abs("skew_") < SKEW) & (F.abs("kurt_") < KURTOSIS), "roughly_normal").otherwise("check_distribution").alias("hint"),
    )


def class_summary(df: DataFrame, by: list[str], value: str = "diameter", digits: int = 6) -> DataFrame:
    """Count, mean, least and largest value per class."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean_diameter"),
        F.min(value).alias("min_diameter"), F.max(value).alias("max_diameter"),
    )


def object_summary(objects: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Counts of objects by state and means of the values that are not 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)), digits)
    ready = F.count_if(F.col("review_status") == "ready")
    return objects.groupBy(*by).agg(
        F.count("*").alias("objects"), F.count_if(F.col("pair_status") == "paired").alias("paired"), ready.alias("ready"),
        (F.count("*") - ready).alias("needs_review"), F.count_if(F.array_contains("flags", "watershed_split")).alias("watershed_splits"),
        mean("inner_major_axis").alias("mean_inner"), mean("outer_major_axis").alias("mean_outer"), mean("shell_thickness").alias("mean_shell"),
    )


def decorated_summary(carriers: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Carriers, decorations on them, mean count and density, mean decoration diameter over those above 0."""
    return carriers.where("outer_major_axis != 0").groupBy(*by).agg(
        F.count("*").alias("carriers"), F.sum("decoration_count").alias("decorations"),
        F.round(F.avg("decoration_count"), digits).alias("mean_count"), F.round(F.avg("density"), digits).alias("mean_density"),
        F.round(F.coalesce(F.avg(F.when(F.col("mean_decoration") > 0, F.col("mean_decoration"))), F.lit(0.0)), digits).alias("mean_decoration"),
    )


def image_warnings(objects: DataFrame, by: list[str], frames: DataFrame | None = None, contrast: float = 18.0) -> DataFrame:
    """Warnings of each image by the shares of edge and unpaired objects, and by its frame.

    frames: by, grey_std (spread of the grey values), scale_method. With them images without objects are rows too, low
    contrast is warned of and so is a scale that nobody gave by hand.
    """
    if frames is not None:
        own = image_warnings(objects, by).withColumnRenamed("warnings", "seen")
        none = F.array().cast("array<string>")
        front = F.array_compact(F.array(
            F.when(F.col("grey_std") < contrast, F.lit("Low contrast")),
            F.when(~F.coalesce("scale_method", F.lit("")).isin("manual_line", "manual_override"), F.lit("Scale was auto-detected; manual scale is recommended")),
        ))
        return frames.join(own, by, "left").select(*by, F.concat(front, F.coalesce("seen", none)).alias("warnings"))
    share = lambda c: F.avg(c.cast("int"))
    edge, alone = share(F.array_contains("flags", "edge")), share(F.col("pair_status") == "partial")
    return objects.groupBy(*by).agg(
        F.array_compact(F.array(
            F.when(edge > 0.25, F.lit("Too many edge objects")), F.when(alone > 0.35, F.lit("Many unpaired objects"))
        )).alias("warnings")
    )


def bin_width(n: Column, low: Column, high: Column, std: Column) -> Column:
    """Scott's rule kept between a 25th and a 6th of the range, snapped to a round number."""
    span = high - low
    least, most = span / 25, span / 6
    scott = F.when(std > 0, 3.49 * std * F.pow(n.cast("double"), F.lit(-1 / 3))).otherwise(span / 10)
    w = F.greatest(least, F.least(most, scott))
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.nullif(w, F.lit(0.0)))))
    options = F.filter(F.array(*[F.lit(f) * mag for f in (0.5, 1.0, 1.5, 2.0, 2.5, 5.0, 10.0)]), lambda c: c >= least * 0.9)
    # The first of equally near options is kept.
    best = F.aggregate(options, F.get(options, F.lit(0)), lambda b, c: F.when(F.abs(c - w) < F.abs(b - w), c).otherwise(b))
    return F.when((n < 2) | (span == 0), 1.0).otherwise(F.greatest(F.lit(0.1), best))


def histogram(df: DataFrame, by: list[str], value: str, width: float | None = None) -> DataFrame:
    """by, bin, low, n with empty bins kept; the width is automatic unless given. NULL and NaN do not count."""
    v = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = v.groupBy(*by).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd"))
    bw = F.lit(float(width)) if width else bin_width(F.col("c"), F.col("lo"), F.col("hi"), F.col("sd"))
    frame = stats.withColumn("bw", bw).select(
        *by, "bw", (F.floor(F.col("lo") / F.col("bw")) * F.col("bw")).alias("start"), (F.ceil(F.col("hi") / F.col("bw")) * F.col("bw")).alias("stop")
    ).withColumn("bins", F.greatest(F.lit(1), F.ceil((F.col("stop") - F.col("start")) / F.col("bw"))).cast("int"))
    at = F.least(F.col("bins") - 1, F.greatest(F.lit(0), F.floor((F.col("v") - F.col("start")) / F.col("bw")))).cast("int")
    keyed = v.join(frame, by) if by else v.crossJoin(F.broadcast(frame))
    counts = keyed.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    empty = frame.select(*by, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "start", "bw")
    return empty.join(counts, [*by, "bin"], "left").select(
        *by, "bin", F.round(F.col("start") + F.col("bin") * F.col("bw"), 6).alias("low"), F.coalesce("n", F.lit(0)).alias("n")
    )


def gaussian_curve(df: DataFrame, by: list[str], value: str, points: int = 120) -> DataFrame:
    """by, i, x, y: normal curve of the group's mean and deviation, scaled to its histogram; none for a constant."""
    v = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    s = v.groupBy(*by).agg(F.count("*").alias("c"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = s.where("c >= 2 and sd >= 1e-9").withColumn("bw", bin_width(F.col("c"), F.col("lo"), F.col("hi"), F.col("sd")))
    s = s.withColumn("a", F.floor(F.col("lo") / F.col("bw")) * F.col("bw")).withColumn("b", F.ceil(F.col("hi") / F.col("bw")) * F.col("bw"))
    p = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")).withColumn("x", F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / points)
    z = (F.col("x") - F.col("m")) / F.col("sd")
    y = F.col("c") * F.col("bw") / (F.col("sd") * 2.5066282746310002) * F.exp(-0.5 * z * z)
    return p.select(*by, "i", F.round("x", 4).alias("x"), F.round(y, 4).alias("y"))
