"""Availability side of a file: does it arrive, does it open, and why not.

Every function takes Columns and returns a Column, so classification is a
map-side projection over the file table.  ``codes`` is the file's array of
issue codes in report order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions.issues import issue_label


def has_any(codes: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in wanted])), F.lit(False))


def first_of(codes: Column, wanted: Sequence[str]) -> Column:
    """First code of the file that belongs to the set, else null."""
    return F.get(F.filter(codes, lambda c: c.isin(*wanted)), F.lit(0))


def fetch_outcome(status: Column) -> Column:
    return (
        F.when(status.isin(*dims.FETCH_DELIVERED), "entregado")
        .when(status.isin(*dims.FETCH_NOT_EVALUATED), "no-evaluado")
        .when(status == dims.FETCH_SERVICE, "servicio")
        .otherwise("fallido")
    )


def delivery_state(codes: Column, fetch_status: Column, status: Column) -> Column:
    outcome = fetch_outcome(fetch_status)
    return (
        F.when(has_any(codes, dims.NOT_A_FILE_CODES), "no-entrega")
        .when(outcome == "fallido", "roto")
        .when(outcome == "no-evaluado", "omitida")
        .when(has_any(codes, dims.BLOCKING_CODES), "roto")
        .when(has_any(codes, dims.LIMITATION_CODES), "no-analizado")
        .when(status.isin("ok", "error"), "ok")
        .otherwise("omitida")
    )


def is_unevaluated(state: Column) -> Column:
    return state.isin(*dims.UNEVALUATED_STATES)


def delivery_cause(state: Column, codes: Column, fetch_status: Column) -> Column:
    """Why a file is not in order; null when it is.

    A file that was never evaluated is explained by its fetch status.
    """
    outcome = fetch_outcome(fetch_status)
    not_arrived = ~outcome.isin("entregado", "servicio")
    found = F.coalesce(
        first_of(codes, dims.BLOCKING_CODES),
        first_of(codes, dims.LIMITATION_CODES),
        F.when(not_arrived, fetch_status),
        F.get(codes, F.lit(0)),
        F.lit(dims.UNKNOWN_CAUSE),
    )
    return F.when(state != "ok", F.when(outcome == "no-evaluado", fetch_status).otherwise(found))


def cause_label(cause: Column, own_label: Column | None = None) -> Column:
    """Dictionary label, else the file's own label of that issue, else the default."""
    own = F.when(F.trim(own_label) != "", F.trim(own_label)) if own_label is not None else F.lit(None)
    return F.when(
        cause.isNotNull(),
        F.when(cause.isin(*dims.ISSUE_LABELS), issue_label(cause))
        .otherwise(F.coalesce(own, F.lit(dims.DEFAULT_ISSUE_LABEL))),
    )


def gated_score(score: Column, codes: Column, fetch_status: Column) -> Column:
    """Score that may enter a mean, judged from fetch status and codes alone."""
    arrived = fetch_status.isin(*dims.FETCH_DELIVERED, dims.FETCH_SERVICE)
    return F.when(arrived & ~has_any(codes, dims.UNREADABLE_CODES), score)


def readable_score(score: Column, state: Column) -> Column:
    """Score that may enter a mean, judged from the delivery state (canonical rule)."""
    return F.when(state == "ok", score)


def measured_score(score: Column, codes: Column) -> Column:
    """Any score, unless it is our own limitation that produced it."""
    return F.when(~has_any(codes, dims.LIMITATION_CODES), score)


def file_status(analysis_ok: Column, codes: Column) -> Column:
    return (
        F.when(analysis_ok, "ok")
        .when(has_any(codes, (*dims.LIMITATION_CODES, *dims.NOT_A_FILE_CODES)), "skipped")
        .otherwise("error")
    )


def matches_causes(cause: Column, codes: Column, wanted: Sequence[str]) -> Column:
    """Any-of match on the main cause or on any code; no request means no filter."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(cause.isin(*wanted), F.lit(False)) | has_any(codes, wanted)
