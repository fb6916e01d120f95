"""Lookups by issue code, as literal maps folded into the expression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import dims


def lookup(key: Column, table: dict, default: Column | str | int | None = None) -> Column:
    """Closed dictionary as a literal map; missing keys take the default."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    # try_element_at: a missing key is a null, never an error, in ANSI mode too.
    found = F.try_element_at(mapping, key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def issue_label(code: Column) -> Column:
    return lookup(code, dims.ISSUE_LABELS, dims.DEFAULT_ISSUE_LABEL)


def issue_category(code: Column) -> Column:
    return (
        F.when(code.isin(*dims.LIMITATION_CODES), "portal")
        .when(code.isin(*dims.AVAILABILITY_CODES), "availability")
        .when(code.isin(*dims.FORMAT_CODES), "format")
        .otherwise("content")
    )


def category_label(category: Column) -> Column:
    return lookup(category, dims.CATEGORY_LABELS)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def structural_code(check: Column) -> Column:
    """Raw check type to issue code; a type nobody mapped is its own code."""
    return lookup(check, {k: v[0] for k, v in dims.STRUCTURAL_CHECKS.items()}, check)


def structural_severity(check: Column) -> Column:
    return lookup(check, {k: v[1] for k, v in dims.STRUCTURAL_CHECKS.items()}, "error")


def is_truncated(stored: Column, count: Column) -> Column:
    return (stored > 0) & (stored < count)


def is_locatable(stored: Column) -> Column:
    return stored > 0


def content_score(error_kinds: Column, warning_kinds: Column, error_cases: Column) -> Column:
    """100 less the kinds of defect, less ten when the errors are very many."""
    raw = (
        F.lit(100)
        - F.least(F.lit(60), error_kinds * 15)
        - warning_kinds * 5
        - F.when(error_cases > 1000, 10).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")


def score_outcome(files: DataFrame, empty_code: str = "sin-datos") -> DataFrame:
    """Final score of an audited table: clean is 100, no rows and no issues is 0."""
    nothing = (F.coalesce("rows", F.lit(0)) == 0) & F.col("content_score").isNull()
    return files.withColumns({
        "rows": F.coalesce("rows", F.lit(0)),
        "error_cells": F.coalesce("error_cells", F.lit(0)),
        "score": F.when(nothing, 0).otherwise(F.coalesce("content_score", F.lit(100))).cast("int"),
        "ok": F.when(nothing, False).otherwise(F.coalesce("analysis_ok", F.lit(True))),
        "empty_code": F.when(nothing, empty_code),
    }).drop("content_score", "analysis_ok")
