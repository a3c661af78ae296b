"""Readers of CSV, JSON, image and text inputs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from granulate.functions.text import number, unreadable

COCO = (
    "images array<struct<id:long,file_name:string,width:int,height:int,source_id:string,nm_per_px:double,metadata:map<string,string>>>, "
    "annotations array<struct<id:long,image_id:long,category_id:long,segmentation:array<array<double>>,area:double,bbox:array<double>,iscrowd:int,"
    "review_status:string,status:string,quality_status:string>>, categories array<struct<id:long,name:string>>"
)
QUANTITIES = ("diameter", "core", "outer", "shell")


def csv_fixed(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """CSV with just these columns as text: an absent file is empty, a missing column blank, others are dropped."""
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    return df.select(*[(F.coalesce(F.col(f"`{f}`"), F.lit("")) if f in df.columns else F.lit("")).alias(f) for f in fields])


def csv_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns of its header, all text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def validation_table(spark: SparkSession, path: str, measured: str = "measured") -> DataFrame:
    """Validation CSV: image_id, particle_id, optional text, reference_ and measured_ of the quantities it has.

    `measured` is the prefix of the measured columns in the file.

    Missing identity columns or no quantity pair is an error; so is a cell that
    is neither a number nor a null token, raised when it is read.
    """
    df = csv_any(spark, path)
    lost = [c for c in ("image_id", "particle_id") if c not in df.columns]
    known = [q for q in QUANTITIES if f"reference_{q}_nm" in df.columns and f"{measured}_{q}_nm" in df.columns]
    if lost or not known:
        raise ValueError(f"missing columns {lost}" if lost else "no comparable quantity pair")
    cell = lambda c: F.when(unreadable(F.col(c)), F.raise_error(F.concat(F.lit(f"{path}: {c} is no number: "), F.col(c))).cast("double")).otherwise(number(F.col(c)))
    text = [c for c in ("morphology", "mode", "magnification", "source", "status", "notes") if c in df.columns]
    return df.select(
        *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("image_id", "particle_id", *text)],
        *[cell(f"reference_{q}_nm").alias(f"reference_{q}") for q in known], *[cell(f"{measured}_{q}_nm").alias(f"measured_{q}") for q in known],
    )


def coco(spark: SparkSession, path: str) -> DataFrame:
    """COCO documents, one row a file, to be flattened by operators.outlines."""
    return spark.read.schema(COCO).option("multiLine", True).json(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder without their content: path, name, stem, folder, length."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return df.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), "length")


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, SHA-256 of files of up to 2 GB."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.sha2("content", 256).alias("file_sha256"))


def png_size(content) -> tuple:
    """Width and height of PNG bytes as Columns, NULL for other content."""
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    at = lambda i: F.when(ok, F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("int"))
    return at(17), at(21)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines of text files as ids."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != ''")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Outline label files: stem, line_no within no order, class_id, points and error (NULL if the line is sound)."""
    t = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.[^.]*$", 1).alias("stem"), F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] != ''")
    pts = F.transform(F.slice("p", 2, 1 << 20), lambda v: v.try_cast("double"))
    cid = F.get("p", F.lit(0)).try_cast("int")
    err = (
        F.when(cid.isNull() | (cid < 0), "bad class").when(F.exists(pts, lambda v: v.isNull()), "bad number")
        .when((F.size(pts) < 6) | (F.size(pts) % 2 != 0), "bad outline").when(F.exists(pts, lambda v: (v < 0) | (v > 1)), "outside the frame")
    )
    return t.select("stem", cid.alias("class_id"), pts.alias("points"), err.alias("error"))


def registry(text: str) -> list[dict]:
    """Entries of a small YAML list of flat maps (scalars, inline lists, quotes, comments), read on the driver."""
    rows: list[dict] = []
    for raw in text.splitlines():
        line = re.sub(r"""(?<!\S)#(?=(?:[^"']*["'][^"']*["'])*[^"']*$).*$""", "", raw).rstrip()
        m = re.match(r"^(\s*)(- )?([A-Za-z_][\w]*):\s*(.*)$", line)
        if not m or not (m.group(1) or m.group(2)):
            continue
        if m.group(2):
            rows.append({})
        if rows:
            rows[-1][m.group(3)] = _scalar(m.group(4))
    return rows


def _scalar(v: str):
    v = v.strip()
    if v[:1] == "[" and v[-1:] == "]":
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0]:
        return v[1:-1]
    return {"true": True, "false": False, "null": None, "": None, "~": None}.get(v.lower(), v)


def run_config(text: str) -> dict:
    """Settings from JSON or flat `key: value` lines."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    return {k.strip(): _scalar(v) for k, _, v in (line.partition(":") for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))}
