"""Writers. Each writes a folder of part files; `one` gathers small reports into one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, one: bool = False) -> None:
    """CSV with header, quotes doubled; columns `fields` in their order, missing ones blank."""
    out = df.select(*[(F.col(f) if f in df.columns else F.lit("")).alias(f) for f in fields]) if fields else df
    (out.coalesce(1) if one else out).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_value(df: DataFrame):
    """A row of `df` as JSON with its keys in alphabetical order, as a Column."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON with its keys in alphabetical order."""
    return df.select(json_value(df).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def diameters(rows: DataFrame, by: list[str], preferred: str) -> DataFrame:
    """by, seq, diameter of the preferred class, of all classes where a group has none of it."""
    have = rows.groupBy(*by).agg(F.max(F.col("class") == preferred).alias("has"))
    return rows.join(have, by).where(~F.col("has") | (F.col("class") == preferred)).select(*by, "seq", "diameter")


def flat_objects(objects: DataFrame) -> DataFrame:
    """Objects ready for CSV: diameter of the outer half, else of the inner one; flags joined by bars."""
    d = F.coalesce(F.nullif("outer_major_axis", F.lit(0.0)), F.col("inner_major_axis"))
    return objects.select(*[c for c in objects.columns if c != "flags"], d.alias("diameter"), F.array_join("flags", "|").alias("flags"))


def markdown(rows: list, columns: list[str], title: str) -> str:
    """A small collected report as a Markdown table."""
    cell = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " - |" * len(columns), *["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]])


def write_manifest(df: DataFrame, path: str, split: str = "split") -> None:
    """Parquet in one folder per split, so readers of one split skip the others."""
    df.repartition(split).write.mode("overwrite").partitionBy(split).parquet(path)
