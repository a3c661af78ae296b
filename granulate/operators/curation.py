"""Upserts, edits, lookups with precedence, and audits of the curation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulate.functions.text import filled
from granulate.operators.ordering import placed


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; extra columns stay."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `new` overwrite the columns they have, blanks included; others are appended, rows without a key left out.

    Of repeated keys in `new` the last by `order` counts. Columns only `old` has are NULL for appended rows.
    """
    n = last_by(new.where(filled(F.col(key).cast("string")).isNotNull()), [key], [F.col(order)]).drop(order)
    shared = [c for c in n.columns if c != key and c in old.columns]
    j = old.join(n.select(F.col(key), F.struct(*n.columns).alias("new")), key, "full")
    return j.select(key, *[
        (F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) if c in shared else F.col(c)).alias(c) for c in old.columns if c != key
    ])


def update_row(df: DataFrame, key: str, value: str, changes: dict[str, Column]) -> DataFrame:
    """The row of this key with changed columns."""
    return df.withColumns({c: F.when(F.col(key) == value, v).otherwise(F.col(c)) for c, v in changes.items()})


def apply_edits(objects: DataFrame, edits: DataFrame, key: str, order: str) -> DataFrame:
    """Objects after edits (action: reject, update, add; value): the last edit of an object counts; values are not recomputed."""
    e = last_by(edits, [key], [F.col(order)]).select(key, "action", F.col("value").alias("edited"))
    kept = objects.join(e, key, "left").where("action is null or action != 'reject'").select(
        *[c for c in objects.columns if c != "value"], F.when(F.col("action") == "update", F.col("edited")).otherwise(F.col("value")).alias("value")
    )
    added = e.where("action = 'add'").join(objects.select(key), key, "left_anti").select(key, F.col("edited").alias("value"))
    return kept.unionByName(added, allowMissingColumns=True)


def index_under(df: DataFrame, names: list[str], order: list) -> DataFrame:
    """Lookup table under several alternative names per row, the last row of a name counts; blank names are left out."""
    keys = F.array_compact(F.array(*[filled(F.col(n).cast("string")) for n in names]))
    return last_by(df.withColumn("name", F.explode(F.array_distinct(keys))), ["name"], order)


def lookup(df: DataFrame, table: DataFrame, first: str, second: str, key_first: str, key_second: str, order: list) -> DataFrame:
    """Left join on the first key, else on the second; found is `first`, `second` or NULL, row the struct found."""
    pick = lambda k: last_by(table.where(filled(F.col(k)).isNotNull()).select(F.col(k).alias("k_"), F.struct("*").alias("row"), F.struct(*order).alias("o_")), ["k_"], [F.col("o_")]).select("k_", "row")
    a, b = pick(key_first).select(F.col("k_").alias(first), F.col("row").alias("ra")), pick(key_second).select(F.col("k_").alias(second), F.col("row").alias("rb"))
    j = df.join(a, first, "left").join(b, second, "left")
    return j.select(*df.columns, F.coalesce("ra", "rb").alias("row"), F.when(F.col("ra").isNotNull(), "first").when(F.col("rb").isNotNull(), "second").alias("found"))


def first_filled(*cols: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[filled(c) for c in cols])


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def missing_fields(fields: list[str], extra: dict[str, Column] | None = None) -> Column:
    """Names of the blank fields and of the conditions that hold, in order."""
    tests = [F.when(blank(f), F.lit(f)) for f in fields] + [F.when(c, F.lit(n)) for n, c in (extra or {}).items()]
    return F.array_compact(F.array(*tests))


def audit_images(images: DataFrame) -> DataFrame:
    """Each image row's missing provenance fields, joined by commas, and how many."""
    m = missing_fields(
        ["source_id", "file_path", "source_url", "license", "file_sha256", "width", "height", "modality", "quality_status"],
        {"caption_or_notes": blank("caption") & blank("notes")},
    )
    return images.select("row_no", F.array_join(m, ",").alias("missing"), F.size(m).alias("n_missing"))


def gap_counts(images: DataFrame, by: list[str]) -> DataFrame:
    """Provenance gaps per group."""
    return images.groupBy(*by).agg(
        F.count("*").alias("images"), F.count_if(blank("caption") & blank("notes")).alias("no_caption"), F.count_if(blank("nm_per_px")).alias("no_scale"),
        F.count_if(blank("file_sha256")).alias("no_checksum"), F.count_if(blank("license")).alias("no_licence"), F.count_if(blank("source_id")).alias("no_source"),
    )


def tally(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns: field, value, n; blank is `unspecified`. One pass."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(filled(F.col(c)), F.lit("unspecified")).alias("value")) for c in columns]))
    return df.select(x.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0 of nothing."""
    return F.coalesce(100 * F.try_divide(part, whole), F.lit(0.0))


def triage_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Files, correct ones, accuracy, and those to be split; rows: predicted, label, marker."""
    right = F.count_if(F.col("predicted") == F.col("label"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("files"), right.alias("correct"), F.round(percent(right, F.count("*")), 6).alias("accuracy_percent"),
        F.count_if(F.col("marker") == "manual_needs_split").alias("split_needed"),
        F.count_if((F.col("predicted") == F.col("label")) & (F.col("marker") != "manual_needs_split")).alias("ready"),
    )


def unmatched_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a row in right (images without labels, masks, files)."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def capped(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows of each group, in order: the feature of a capped report."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= most)


def first_seen_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """name, id: ids from 0 in the order of first sight."""
    f = df.groupBy(name).agg(F.min(order).alias("seen"))
    return placed(f, ["seen", name], "id").select(name, "id")


def combine(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of datasets with prefixed keys; missing columns are NULL, a dataset column names the origin."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(key, F.concat(F.lit(name + ":"), F.col(key).cast("string"))).withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
