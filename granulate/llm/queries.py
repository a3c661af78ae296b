"""Registered queries of the curation problems; SQL twins where SQL is quick enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulate.llm import canonical, crosssplit, groupsplit, history, leakage, mixture, oracles, quality, truncation
from granulate.session import read


def p1_found(spark, d):
    return truncation.found(read(spark, d, "images"), read(spark, d, "sources"))


def p1_shares(spark, d):
    return truncation.shares(read(spark, d, "images"), read(spark, d, "sources"))


def p2_found(spark, d):
    return crosssplit.found(read(spark, d, "images"), read(spark, d, "figure_triage"))


def p2_counts(spark, d):
    return crosssplit.counts(read(spark, d, "images"), read(spark, d, "figure_triage"))


def p3_found(spark, d):
    return groupsplit.found(read(spark, d, "images"), read(spark, d, "sources"))


def p3_assign(spark, d):
    return groupsplit.assign(read(spark, d, "images"), read(spark, d, "sources"))


def p3_shares(spark, d):
    rows = groupsplit.assign(read(spark, d, "images"), read(spark, d, "sources"))
    return rows.groupBy("new_split").agg(F.count("*").alias("n_rows"), F.countDistinct("group").alias("groups"))


def p4_found(spark, d):
    return canonical.found(read(spark, d, "sources"), read(spark, d, "licence_terms"))


def p4_unmatched(spark, d):
    return canonical.unmatched(read(spark, d, "sources"), read(spark, d, "licence_terms"))


def p6_found(spark, d):
    return history.found(read(spark, d, "images"), read(spark, d, "image_batches"))


def p7_found(spark, d):
    return leakage.found(read(spark, d, "documents"), read(spark, d, "heldout_items"))


def p7_items(spark, d):
    return leakage.leaked_items(read(spark, d, "documents"), read(spark, d, "heldout_items"))


def p8_mix(spark, d):
    return mixture.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixture.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark, d):
    return quality.found(read(spark, d, "documents"))


def p9_scores(spark, d):
    return quality.scored(read(spark, d, "documents"))


def p9_summary(spark, d):
    return quality.summary(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_counts, p3_found, p3_assign, p3_shares, p4_found, p4_unmatched, p6_found, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_scores, p9_summary)}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
