"""Extension (the batch tables have no event time): object edits as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulate.operators.curation import last_by


def edit_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Edits arriving as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def last_edits(edits: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Tallies of edits per ten-minute window and action, for rows at most `late` behind."""
    return edits.withWatermark(ts, late).groupBy(F.window(ts, "10 minutes"), "action").agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("objects"))


def versions(spark: SparkSession, table: str) -> list[int]:
    """Versions of `table` that were written whole, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(path)]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n[2:]) for n, p in found if n.startswith("v=") and n[2:].isdigit() and done(p))


def upsert_stream(edits: DataFrame, key: str, ts: str, table: str, checkpoint: str):
    """Keeps the last edit of every key: `table`/v=<n> is the state after micro-batch n.

    Batch n goes on from the newest whole version before it; a repeated batch is
    written anew. A batch that is not the first of its stream and finds no
    version, or one that cannot be read, stops the stream: state is never begun
    anew over a failure. Micro-batches without rows may leave gaps in the numbers.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = last_by(batch, [key], [F.col(ts)])
        before = [v for v in versions(spark, table) if v < n]
        if before:
            new = last_by(spark.read.parquet(f"{table}/v={before[-1]}").unionByName(new), [key], [F.col(ts)])
        elif n > 0:
            raise RuntimeError(f"no whole version of {table} before micro-batch {n}")
        new.write.mode("overwrite").parquet(f"{table}/v={n}")

    return edits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
