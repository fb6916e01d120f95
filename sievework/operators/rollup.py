"""Roll-ups of the report: by dataset, by format, grand totals, by issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.functions import issues as I
from sievework.functions import numbers as N
from sievework.functions import scores as S


def _file_measures() -> list[Column]:
    score = D.gated_score(F.col("score"), F.col("codes"), F.col("fetch_status"))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(~F.col("status").isin("ok", "skipped")).alias("error"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("fetch_status").isin(*dims.FETCH_DELIVERED)).alias("downloaded"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.count(score).alias("scored"),
        F.sum(score).alias("score_sum"),
    ]


def report_rollup(files: DataFrame) -> DataFrame:
    """Datasets, formats and grand total from one pass over the file table.

    ``level`` says which grouping a row belongs to.  Sums, not means, are
    carried up, so the three levels share the map-side partial aggregation.
    """
    d, f = F.col("dataset_id"), F.col("format")
    grouped = files.groupingSets([[d], [f], []], d, f).agg(
        *_file_measures(), F.grouping_id().alias("gid")
    )
    mean = F.col("score_sum") / F.col("scored")
    level = F.when(F.col("gid") == 1, "dataset").when(F.col("gid") == 2, "format").otherwise("total")
    # Dataset scores are whole numbers; formats and the total keep one decimal.
    score = F.when(
        F.col("scored") > 0,
        F.when(F.col("gid") == 1, N.round_half_up(mean).cast("double")).otherwise(N.round_half_up(mean, 1)),
    )
    return grouped.select(
        level.alias("level"), "dataset_id", "format", "total", "ok", "error", "skipped",
        "downloaded", "bytes", score.alias("avg_score"),
        N.percent(F.col("ok"), F.col("total")).alias("coverage_pct"),
    )


def by_dataset(files: DataFrame) -> DataFrame:
    measures = files.groupBy("dataset_id").agg(*_file_measures())
    return measures.select(
        "dataset_id", F.col("total").alias("files"), F.col("ok").alias("analyzed"),
        F.col("error").alias("failed"), "skipped",
        F.when(F.col("scored") > 0, N.round_half_up(F.col("score_sum") / F.col("scored"))).alias("score"),
        N.percent(F.col("ok"), F.col("total")).alias("coverage_pct"),
    )


def by_format(files: DataFrame) -> DataFrame:
    measures = files.groupBy("format").agg(*_file_measures())
    return _with_mean(measures, "format")


def totals(files: DataFrame) -> DataFrame:
    return _with_mean(files.agg(*_file_measures()))


def _with_mean(measures: DataFrame, *keys: str) -> DataFrame:
    return measures.select(
        *keys, "total", "ok", "error", "skipped", "downloaded", "bytes",
        F.when(F.col("scored") > 0, N.round_half_up(F.col("score_sum") / F.col("scored"), 1)).alias("avg_score"),
    )


def issues_with_owner(issues: DataFrame, files: DataFrame, *columns: str) -> DataFrame:
    """Issues with columns of their file; the file id is unique on the file side."""
    return issues.join(files.select("file_id", *columns), "file_id")


def issues_by_code(issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row per (dataset, code): summed cases, files, worst severity."""
    owned = issues_with_owner(issues, files, "dataset_id")
    return owned.groupBy("dataset_id", "code").agg(
        F.sum("count").alias("cases"),
        F.count(F.lit(1)).alias("files"),
        F.min(I.severity_rank(F.col("severity"))).alias("rank"),
    ).select(
        "dataset_id", "code", "cases", "files",
        F.when(F.col("rank") == 0, "error").when(F.col("rank") == 1, "warning").otherwise("info").alias("severity"),
    )


def issue_maps(by_code: DataFrame) -> DataFrame:
    """The same as two maps per dataset; bounded by the code vocabulary."""
    return by_code.groupBy("dataset_id").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "cases"))).alias("issues_by_code"),
        F.map_from_entries(F.collect_list(F.struct("code", "severity"))).alias("issue_severity"),
    )


def format_issues(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issue cases per format, the most frequent first within a format."""
    return issues_with_owner(issues, files, "format").groupBy("format", "code").agg(
        F.sum("count").alias("cases")
    )


def files_by_issue(issues: DataFrame) -> DataFrame:
    """Files affected per code; each file counts once per code."""
    return (
        issues.groupBy("code", "file_id").agg(F.sum("count").alias("n"))
        .groupBy("code").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("cases"))
        .select("code", "files", "cases", I.issue_category(F.col("code")).alias("category"),
                I.issue_label(F.col("code")).alias("label"))
    )


def reuse_consequences(files: DataFrame) -> DataFrame:
    """Files per consequence group, each once per group; groups with none are left out.

    All groups come out of one aggregate over the array of codes.
    """
    counts = files.agg(*[
        F.count_if(D.has_any(F.col("codes"), codes)).alias(f"g{i}")
        for i, (codes, *_rest) in enumerate(dims.CONSEQUENCE_GROUPS)
    ])
    groups = F.array(*[
        F.struct(F.lit(icon).alias("icon"), F.lit(severity).alias("severity"),
                 F.lit(title).alias("title"), F.col(f"g{i}").alias("files"))
        for i, (_codes, icon, severity, title) in enumerate(dims.CONSEQUENCE_GROUPS)
    ])
    return (
        counts.select(F.inline(groups)).filter(F.col("files") > 0)
        .orderBy(F.when(F.col("severity") == "bad", 0).otherwise(1), F.desc("files"), "icon")
    )


def issue_totals(issues: DataFrame) -> DataFrame:
    """Error and warning cases per file, never added together; info is in neither."""
    return issues.groupBy("file_id").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("count")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("count")).otherwise(0)).alias("warnings"),
    )


def dataset_lite(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Light per-dataset view; expects volume columns ``rows`` and ``cols`` per file."""
    joined = files.join(issue_totals(issues), "file_id", "left")
    grouped = joined.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "ok").alias("analyzed"),
        F.count_if(~F.col("status").isin("ok", "skipped")).alias("failed"),
        F.max("rows").alias("max_rows"), F.max("cols").alias("max_cols"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_issues"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_issues"),
        N.round_half_up(F.avg(D.readable_score(F.col("score"), F.col("state")))).alias("score"),
        N.percent_or_null(F.count_if(F.col("state") == "ok"),
                          F.count_if(~D.is_unevaluated(F.col("state")))).alias("availability_pct"),
    )
    status = (
        F.when(F.col("files") == 0, "sin-datos")
        .when(F.col("analyzed") == F.col("files"), "ok")
        .when(F.col("failed") == F.col("files"), "error")
        .otherwise("parcial")
    )
    return grouped.withColumn("analysis_state", status)


def volume(fmt: Column, m: dict[str, Column]) -> tuple[Column, Column]:
    """Which metric is the volume of a file, by format: (primary, secondary)."""
    null = F.lit(None).cast("bigint")

    def get(name: str) -> Column:
        return m.get(name, null)

    up = F.upper(fmt)
    primary = (
        F.when(up.isin("JSON", "GEOJSON"), F.coalesce(get("elements"), get("rows")))
        .when(up.isin("XLSX", "XLS"), F.coalesce(get("total_rows"), get("rows")))
        .when(up.isin("XML", "RDF", "RSS"), get("total_elements"))
        .when(up == "WFS", get("feature_types"))
        .when(up == "WMS", get("layers"))
        .when(up == "SHP", get("features"))
        .when((up == "TXT") & get("rows").isNull(), get("lines"))
        .otherwise(get("rows"))
    )
    secondary = (
        F.when(up.isin("XLSX", "XLS"), F.coalesce(get("sheet_count"), get("columns")))
        .when(up.isin("XML", "RDF", "RSS"), F.coalesce(get("items"), get("dcat_datasets")))
        .when(up.isin("WFS", "WMS"), null)
        .when(up == "SHP", get("fields"))
        .when((up == "TXT") & get("rows").isNull(), null)
        .otherwise(get("columns"))
    )
    return primary, secondary


def analyzed_cells(rows: Column, columns: Column) -> Column:
    return F.coalesce(rows * columns, F.lit(0).cast("bigint"))


def scorecard(datasets: DataFrame, files: DataFrame) -> DataFrame:
    """Composite score and level of every dataset."""
    from sievework.operators.files import dataset_scores

    joined = datasets.join(dataset_scores(files), "dataset_id", "left")
    composite = S.composite_score(F.col("metadata_score"), F.col("availability"), F.col("content"))
    return joined.withColumn("composite", composite).withColumn("level", S.score_level(F.col("composite")))


def level_histogram(scored: DataFrame, score: str = "content") -> DataFrame:
    return scored.groupBy(S.histogram_level(F.col(score)).alias("level")).agg(
        F.count(F.lit(1)).alias("datasets"))


def by_publisher(scored: DataFrame, publisher: str = "publisher", score: str = "content") -> DataFrame:
    return scored.groupBy(publisher).agg(
        F.count(F.lit(1)).alias("datasets"), F.count(score).alias("scored"),
        N.round_half_up(F.avg(score), 1).alias("avg_score"))


def catalog_score(scored: DataFrame) -> DataFrame:
    """Mean of the composites, not the composite of the means."""
    score = N.round_half_up(F.avg("composite"))
    return scored.agg(score.alias("score"), F.count("composite").alias("datasets")).withColumn(
        "level", S.score_level(F.col("score")))
