"""File table: codes attached, delivery classified, synthesised issues.

Inputs
------
files   one row per file: file_id, dataset_id, idx, format, url, fetch_status,
        status, score, size_bytes, ...
issues  one row per (file_id, code): severity, count, optional ord
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.functions import numbers as N


def empty_codes() -> Column:
    return F.array().cast("array<string>")


def codes_per_file(issues: DataFrame, order: str | None = None) -> DataFrame:
    """Codes of each file in report order (by ``order`` when given, else by name).

    One entry per (file, code), so a list never outgrows the code vocabulary.
    """
    if order is None:
        codes = F.array_sort(F.collect_set("code"))
    else:
        codes = F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("code").alias("c")))),
            lambda s: s["c"],
        ))
    return issues.groupBy("file_id").agg(codes.alias("codes"))


def with_codes(files: DataFrame, issues: DataFrame, order: str | None = None) -> DataFrame:
    """Left join on the file id, unique on both sides."""
    return (
        files.join(codes_per_file(issues, order), "file_id", "left")
        .withColumn("codes", F.coalesce("codes", empty_codes()))
    )


def classify_delivery(files: DataFrame) -> DataFrame:
    """Adds ``state`` and ``cause`` (null when the file is in order)."""
    state = D.delivery_state(F.col("codes"), F.col("fetch_status"), F.col("status"))
    return files.withColumn("state", state).withColumn(
        "cause", D.delivery_cause(F.col("state"), F.col("codes"), F.col("fetch_status"))
    )


def issues_from_fetch(files: DataFrame) -> DataFrame:
    """Status and issue that follow from the fetch alone, before any analysis.

    Rows whose bytes are there to be analysed come back with null status.
    ``crashed`` (analyser failed) and ``content`` (first bytes) are optional.
    """
    empty = F.col("size_bytes") == 0
    if "content" in files.columns:
        empty = is_effectively_empty(F.col("size_bytes"), F.col("content"))
    crashed = F.col("crashed") if "crashed" in files.columns else F.lit(False)
    st = F.col("fetch_status")

    def decide(status: str, code: str | None = None, severity: str | None = None) -> Column:
        parts = {"status": status, "code": code, "severity": severity}
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in parts.items()])

    decided = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", decide("skipped"))
        .when(st.isin("no_url", "too_large"), decide("skipped"))
        .when(st.isin("http_error", "unreachable"), decide("error", "descarga", "error"))
        # Not evaluated is not the same as empty: the fetch status explains it.
        .when(st == "error", decide("error"))
        .when((st != dims.FETCH_SERVICE) & empty, decide("error", "archivo-vacio", "error"))
        .when(crashed, decide("skipped", "fallo-analizador", "info"))
    )
    return files.withColumn("__d", decided).select(
        *files.columns,
        F.col("__d.status").alias("fetch_decides"),
        F.col("__d.code").alias("issue_code"),
        F.col("__d.severity").alias("issue_severity"),
    )


def is_effectively_empty(length, content):
    """No bytes, or at most 64 and all of them blank."""
    blank = ~F.decode(F.substring(content, 1, 64), "ISO-8859-1").rlike(r"[^\x09-\x0d\x20]")
    return (length == 0) | ((length <= 64) & F.coalesce(blank, F.lit(False)))


def unknown_statuses(files: DataFrame) -> DataFrame:
    """Rows of a fetch log whose status is none of the eight known ones."""
    known = F.col("fetch_status").isin(*dims.FETCH_STATUSES)
    return files.filter(~F.coalesce(known, F.lit(False)))


def delivery_summary(files: DataFrame) -> DataFrame:
    """Counts per state, percentages and affected datasets, as one row."""
    def n(state: str):
        return F.count_if(F.col("state") == state).alias(state.replace("-", "_"))

    # Per dataset first, so the distinct count of datasets is a plain count.
    per_dataset = files.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total"), *[n(s) for s in dims.DELIVERY_STATES]
    )
    names = [s.replace("-", "_") for s in dims.DELIVERY_STATES]
    return per_dataset.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
        F.count_if((F.col("roto") + F.col("no_entrega")) > 0).alias("affected_datasets"),
        F.count(F.lit(1)).alias("total_datasets"),
    ).select(
        "total", *names,
        N.percent(F.col("roto"), F.col("total")).alias("broken_pct"),
        N.percent(F.col("no_entrega"), F.col("total")).alias("not_a_file_pct"),
        "affected_datasets", "total_datasets",
    )


def content_summary(files: DataFrame) -> DataFrame:
    score = D.readable_score(F.col("score"), F.col("state"))
    return files.agg(
        F.count(score).alias("scored"), N.round_half_up(F.avg(score), 1).alias("avg_score")
    )


def dataset_scores(files: DataFrame) -> DataFrame:
    """Per dataset: mean readable score and share of evaluated files that open."""
    readable = D.readable_score(F.col("score"), F.col("state"))
    evaluated = F.count_if(~D.is_unevaluated(F.col("state")))
    opened = F.count_if(F.col("state") == "ok")
    return files.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("files"),
        N.round_half_up(F.avg(readable)).alias("content"),
        N.percent_or_null(opened, evaluated).alias("availability"),
    )


def format_states(files: DataFrame) -> DataFrame:
    """ok / parcial / roto / sin-datos for each format of each dataset."""
    grouped = files.groupBy("dataset_id", "format").agg(
        F.count_if(~D.is_unevaluated(F.col("state"))).alias("evaluated"),
        F.count_if(F.col("state") == "ok").alias("ok"),
    )
    state = (
        F.when(F.col("evaluated") == 0, "sin-datos")
        .when(F.col("ok") == F.col("evaluated"), "ok")
        .when(F.col("ok") == 0, "roto")
        .otherwise("parcial")
    )
    return grouped.select("dataset_id", "format", "evaluated", "ok", state.alias("format_state"))


def format_content_scores(files: DataFrame) -> DataFrame:
    score = D.measured_score(F.col("score"), F.col("codes"))
    return files.groupBy("format").agg(
        F.count(score).alias("scored"), N.round_half_up(F.avg(score), 1).alias("avg_score")
    )


def broken_datasets(files: DataFrame) -> DataFrame:
    """Datasets with at least one failing file."""
    return files.groupBy("dataset_id").agg(
        F.count_if(F.col("state").isin("roto", "no-entrega")).alias("failing")
    ).filter(F.col("failing") > 0)


def select_files(files: DataFrame, formats: Sequence[str] = (), limit: int | None = None,
                 order: str = "file_id") -> DataFrame:
    """Only some formats (any case), then the first ``limit`` in catalogue order."""
    out = files
    if formats:
        out = out.filter(F.upper("format").isin(*[f.upper() for f in formats]))
    if limit is not None:
        out = out.orderBy(order).limit(limit)
    return out
