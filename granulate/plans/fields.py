"""Query of packed fields (problem 5)."""

from __future__ import annotations

from granulate.operators import multivalue
from granulate.session import read


def p5_found(spark, d):
    return multivalue.split_fields(read(spark, d, "sources"), "row_no", ["authors", "keywords"])


QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}
