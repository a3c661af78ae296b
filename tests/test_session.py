"""Session helpers and the edit stream."""

import pytest
from pyspark.sql import functions as F

from granulate import session
from granulate.streaming import edits


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    def __init__(self, master):
        self.sparkContext, self.conf = _Context(master), _Conf()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(_Session("spark://host:7077"))


def test_large_inputs_are_not_moved(spark, monkeypatch):
    df = spark.range(1000, numPartitions=1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "MOVED", 0)
    assert session.spread(df).rdd.getNumPartitions() == 1


def _run(spark, tmp_path):
    stream = edits.edit_stream(spark, str(tmp_path / "in"), "k long, v string, ts timestamp")
    edits.upsert_stream(stream, "k", "ts", str(tmp_path / "table"), str(tmp_path / "state")).start().awaitTermination()


def test_edits_keep_the_last_one_and_survive_nothing_silently(spark, tmp_path):
    put = lambda i, *rows: spark.createDataFrame(rows, "k long, v string, s string").select("k", "v", F.to_timestamp("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0, (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:00"))
    _run(spark, tmp_path)
    put(1, (1, "c", "2024-01-02 00:00:00"))
    _run(spark, tmp_path)
    assert edits.versions(spark, str(tmp_path / "table")) == [0, 1]
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "table/v=1")).collect()} == {(1, "c"), (2, "b")}
    # A version that is lost or damaged stops the stream, and the state is not begun anew.
    for v in ("v=0", "v=1"):
        (tmp_path / "table" / v / "_SUCCESS").unlink()
    put(2, (3, "d", "2024-01-03 00:00:00"))
    with pytest.raises(Exception, match="no whole version"):
        _run(spark, tmp_path)
    assert not (tmp_path / "table/v=2").exists()
