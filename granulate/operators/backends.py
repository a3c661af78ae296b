"""Segmentation back-ends: functions from frames to detections, found by name, whose results are checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulate.operators import raster

# A result names its image and has one score a detection.
COLUMNS = {"image_id", "seq", "cx", "cy", "area_px"}
Backend = Callable[[DataFrame], DataFrame]
_BACKENDS: dict[str, tuple[Backend, bool, str]] = {}


def register(name: str, predict: Backend, about: str = "", review: bool = True) -> None:
    """Adds or replaces a back-end; its detections need review unless `review` is False."""
    _BACKENDS[name] = (predict, review, about)


def available() -> list[tuple[str, str]]:
    """Names and descriptions in alphabetical order."""
    return sorted((n, about) for n, (_, _, about) in _BACKENDS.items())


def backend(name: str) -> tuple[Backend, bool, str]:
    """The back-end of this name; an unknown name is an error that lists the known ones."""
    if name not in _BACKENDS:
        raise KeyError(f"unknown back-end {name!r}; known are {[n for n, _ in available()]}")
    return _BACKENDS[name]


def predict(name: str, frames: DataFrame) -> DataFrame:
    """Detections of a back-end with its name, whether they need review, and a score (NULL if it gives none).

    A result that lacks a column, or has a detection without an image, is an error.
    """
    run, review, _ = backend(name)
    found = run(frames)
    if lost := COLUMNS - set(found.columns):
        raise ValueError(f"{name} gives no {sorted(lost)}")
    sound = F.when(F.col("image_id").isNull(), F.raise_error(F.lit(f"{name}: a detection has no image")).cast("string")).otherwise(F.lit(name))
    score = F.col("score").cast("double") if "score" in found.columns else F.lit(None).cast("double")
    return found.withColumn("score", score).withColumn("backend", sound).withColumn("review_required", F.lit(review))


register("classical", raster.detect, "threshold and connected components")
register("manual", lambda rows: rows, "detections that somebody drew, as they are", review=False)
