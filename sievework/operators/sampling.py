"""Stratified samples for re-checking, and what the re-check found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.sniff import looks_like_html, service_exception
from sievework.operators.groups import join_by_key, number_within

# Verdict rules.
DOWNLOAD_CAUSES = ("descarga", "archivo-vacio")
MAX_CHECK_BYTES = 32 * 1024 * 1024
MIN_PER_CAUSE = 2


def sample_plan(broken: DataFrame, size: int, cause: str = "cause") -> DataFrame:
    """Per cause: how many files, the step between picks, and picks allowed.

    Shares are proportional with a minimum of two; picking stops at twice the
    size over all causes, the largest first.  Causes are a closed vocabulary,
    so this table is small and the window over it harmless.
    """
    counts = broken.groupBy(cause).agg(F.count(F.lit(1)).alias("broken"))
    all_causes = Window.partitionBy(F.lit(0))
    total = F.sum("broken").over(all_causes)
    wanted = F.greatest(F.lit(MIN_PER_CAUSE), F.floor(F.col("broken") / total * size + 0.5))
    step = F.greatest(F.lit(1), F.floor(F.col("broken") / wanted)).cast("bigint")
    planned = counts.withColumn("step", step).withColumn(
        "picks", F.ceil(F.col("broken") / F.col("step")).cast("bigint"))
    earlier = all_causes.orderBy(F.desc("broken"), cause).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(2 * size) - F.coalesce(F.sum("picks").over(earlier), F.lit(0))
    return planned.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("picks"), left)))


def stratified_sample(broken: DataFrame, size: int, cause: str = "cause", order: str = "file_id") -> DataFrame:
    """Files picked at even steps along each cause, in report order.

    Ranks inside a cause come from blocks of ``order``, so a cause holding most
    of the files is neither sorted nor joined in one task.
    """
    ranked = number_within(broken, [cause], order, "__rank", sparse=True)
    plan = sample_plan(broken, size, cause)
    counts = plan.select(cause, F.col("broken").alias("n"))
    at = F.col("__rank") - 1
    return join_by_key(ranked, plan, [cause], order, "inner", counts).filter(
        (at % F.col("step") == 0) & (F.floor(at / F.col("step")) < F.col("allowed"))
    ).drop("__rank", "step", "picks", "allowed", "broken")


def broken_census(broken: DataFrame, cause: str = "cause") -> DataFrame:
    """Broken files per cause with the formats and HTTP statuses seen."""
    return broken.groupBy(cause).agg(
        F.count(F.lit(1)).alias("broken"),
        F.array_sort(F.collect_set("format")).alias("formats"),
        F.array_sort(F.collect_set("http_status")).alias("http_statuses"))


def verdict(cause: Column, fmt: Column, http_status: Column, size: Column, content: Column,
            json_ok: Column, xml_ok: Column, zip_entries: Column, content_type: Column | None = None) -> Column:
    """confirmado / discrepa / inconcluso from what a second download showed.

    ``json_ok`` and ``xml_ok`` say whether the body parses; ``zip_entries`` is
    the number of entries, null when the archive does not open.  A null HTTP
    status means the server was not reached.
    """
    is_zip = F.hex(F.substring(content, 1, 2)) == "504B"
    rejects = service_exception(content).isNotNull() & (F.length(content) > 0)
    confirmed, disputed, unclear = F.lit("confirmado"), F.lit("discrepa"), F.lit("inconcluso")

    def claim(still_broken: Column) -> Column:
        return F.when(still_broken, confirmed).otherwise(disputed)

    by_content = (
        F.when(cause == "json-invalido", claim(~json_ok))
        .when(cause == "xml-no-bien-formado", claim(~xml_ok))
        .when(cause == "formato-no-esperado", claim(~is_zip))
        .when(cause == "zip-invalido", claim(F.coalesce(zip_entries, F.lit(0)) == 0))
        .when(cause.isin("servicio-error", "error-fuente"),
              F.when(rejects | (is_zip & (fmt != "SHP")), confirmed).otherwise(unclear))
        .otherwise(unclear)
    )
    failed = http_status.isNull() | ((http_status != 206) & ((http_status < 200) | (http_status >= 300)))
    return (
        F.when(failed, confirmed)
        .when(F.coalesce(looks_like_html(content), F.lit(False)) & (fmt != "HTML"), confirmed)
        .when(size == 0, confirmed)
        .when(cause.isin(*DOWNLOAD_CAUSES), disputed)
        .when(size > MAX_CHECK_BYTES, unclear)
        .otherwise(by_content)
    )


def verification_summary(broken: DataFrame, checked: DataFrame, cause: str = "cause") -> DataFrame:
    """Per cause: broken, checked and the three verdicts."""
    results = checked.groupBy(cause).agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmado", "discrepa", "inconcluso")])
    totals = broken.groupBy(cause).agg(F.count(F.lit(1)).alias("broken"))
    joined = totals.join(results, cause, "left")
    return joined.select(cause, "broken", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("checked", "confirmado", "discrepa", "inconcluso")
    ]).orderBy(F.desc("broken"), cause)
