"""Registered queries: every SQL twin has a query, the flagship runs, and twins agree on the smallest tables if they are there."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["validation_agreement", "histogram_auto", "pair_outer", "object_rows", "split_assign", "rule_classes", "triage_classes"])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    a, b = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            assert abs(a[c].sum() - b[c].sum()) < 1e-6 * max(1, abs(a[c].sum()))
