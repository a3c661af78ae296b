"""Layers of an image row: what it shows, what may be shared, and the single label of older manifests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulate.functions.text import joined, licence_status

# States of a scale that somebody confirmed, and licence states of public rows.
CONFIRMED = ("confirmed", "manual_line", "manual", "metadata")
OPEN_STATES = ("verified", "accepted", "public", "cc_by", "cc0")


def distribution_layer(public_image: Column, public_source: Column) -> Column:
    """public_demo if the image or its source may be shared, else private_training."""
    return F.when(F.coalesce(public_image, F.lit(False)) | F.coalesce(public_source, F.lit(False)), "public_demo").otherwise("private_training")


def _synthetic(*texts: Column) -> Column:
    return F.contains(joined(*texts), F.lit("synthetic"))


def training_layer(public: Column, source_type: Column, notes: Column) -> Column:
    """One label, the licence first: public_demo, synthetic_core_shell or private_training."""
    return F.when(public, "public_demo").when(_synthetic(source_type, notes), "synthetic_core_shell").otherwise("private_training")


def dataset_layer(public: Column, source_type: Column, notes: Column) -> Column:
    """The exporter's label, synthetic first."""
    return F.when(_synthetic(source_type, notes), "synthetic_core_shell").when(public, "public_demo").otherwise("private_training")


def has_confirmed_scale(status: Column, nm_per_px: Column) -> Column:
    """Whether a scale is given and its state says that it was confirmed."""
    given = F.trim(F.coalesce(nm_per_px, F.lit(""))) != ""
    return given & F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*CONFIRMED)


def matches(layer: str, *axes: Column) -> Column:
    """Whether one of the axes is the layer; `all` matches every row."""
    return F.lit(True) if layer == "all" else F.coalesce(F.array_contains(F.array(*axes), layer), F.lit(False))


def licence_decision(text: Column) -> Column:
    """struct(status, decision): accepted licences are accepted, missing and other ones rejected."""
    status = licence_status(text)
    return F.struct(status.alias("status"), F.when(status == "accepted", "accepted").otherwise("rejected").alias("decision"))


def discovery_decision(status: Column, fallback: str = "needs_review") -> Column:
    """approved for open states, rejected for rejected or blocked ones, else the fallback."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin(*OPEN_STATES), "approved").when(s.contains("reject") | s.contains("blocked"), "rejected").otherwise(fallback)
