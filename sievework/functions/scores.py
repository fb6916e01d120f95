"""Composite score, levels and headline tones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions.issues import lookup
from sievework.functions.numbers import round_half_up


def composite_score(metadata: Column, availability: Column, content: Column) -> Column:
    """Weighted score; held below the top band while availability is under 80.

    Unknown availability leaves metadata alone; with availability known, an
    unknown content or metadata part counts as nothing earned.
    """
    w = dims.COMPOSITE_WEIGHTS
    weighted = round_half_up(
        F.coalesce(metadata, F.lit(0)) * F.lit(w["metadata"])
        + availability * F.lit(w["availability"])
        + F.coalesce(content, F.lit(0)) * F.lit(w["content"])
    )
    return (
        F.when(availability.isNull(), round_half_up(metadata))
        .when(availability < dims.SCORE_OK, F.least(weighted, F.lit(dims.SCORE_OK - 1).cast("bigint")))
        .otherwise(weighted)
    )


def score_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= dims.SCORE_OK, "ok")
        .when(score >= dims.SCORE_WARN, "warn")
        .otherwise("bad")
    )


def level_label(level: Column) -> Column:
    return lookup(level, dims.SCORE_LEVEL_LABELS)


def dataset_status(score: Column) -> Column:
    return lookup(score_level(score), dims.DATASET_STATUS)


def histogram_level(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unscored")
        .when(score >= dims.SCORE_OK, "good")
        .when(score >= dims.SCORE_WARN, "fair")
        .otherwise("poor")
    )


def broken_tone(broken_pct: Column) -> Column:
    return F.when(broken_pct >= 15, "bad").when(broken_pct >= 5, "warn").otherwise("ok")


def mean_tone(mean_score: Column) -> Column:
    return (
        F.when(mean_score.isNull(), "warn")
        .when(mean_score < 60, "bad")
        .when(mean_score < 80, "warn")
        .otherwise("ok")
    )


def layer_score(missing_parts: Column, null_geometries: Column, features: Column) -> Column:
    """Feature layer: minus 5 per missing part, minus 15 for null geometries, 0 if empty."""
    raw = F.lit(100) - missing_parts * 5 - F.when(null_geometries > 0, 15).otherwise(0)
    return F.when(features == 0, 0).otherwise(F.greatest(F.lit(0), raw)).cast("int")
