"""Issues of a file: scoring, merging, ordering, and their located occurrences.

Occurrences are one row each: (file_id, code, sheet, col, field, row_no, cell).
``row_no`` is the physical 1-based row (header = 1); ``col`` is 0-based and
null for findings about a whole row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import issues as I
from sievework.functions.cells import clip
from sievework.operators.groups import _null_safe_join, block_of, number_within


def score_files(issues: DataFrame, key: str = "file_id") -> DataFrame:
    """Content score of each file that has issues; a file without any scores 100."""
    err, warn = F.col("severity") == "error", F.col("severity") == "warning"
    cases = F.coalesce(F.sum(F.when(err, F.col("count"))), F.lit(0))
    return issues.groupBy(key).agg(
        I.content_score(F.count_if(err), F.count_if(warn), cases).alias("content_score"),
        (cases == 0).alias("analysis_ok"),
    )


def merge_issues(issues: DataFrame, by: Sequence[str] = ("file_id", "code")) -> DataFrame:
    """Several findings of one code become one: counts add up, error wins."""
    return issues.groupBy(*by).agg(
        F.sum("count").alias("count"), F.min(I.severity_rank(F.col("severity"))).alias("__r")
    ).withColumn(
        "severity", F.when(F.col("__r") == 0, "error").when(F.col("__r") == 1, "warning").otherwise("info")
    ).drop("__r")


def from_occurrences(occurrences: DataFrame) -> DataFrame:
    """Issue rows counted from their occurrences."""
    severity = F.when(F.col("code").isin("celda-faltante", "fila-duplicada"), "warning").otherwise("error")
    return occurrences.groupBy("file_id", "code").agg(
        F.count(F.lit(1)).alias("count"), F.count("row_no").alias("stored")
    ).withColumn("severity", severity)


def impact_share(issues: DataFrame) -> DataFrame:
    """Share of the file's largest issue, and the place in display order.

    A file has at most one row per code, so the window never outgrows the
    code vocabulary.
    """
    file = Window.partitionBy("file_id")
    order = file.orderBy(I.severity_rank(F.col("severity")), F.desc("count"), "code")
    return issues.withColumn("impact", F.col("count") / F.max("count").over(file)).withColumn(
        "place", F.row_number().over(order))


def order_issues(issues: DataFrame) -> DataFrame:
    """Errors first, then by volume, info last."""
    return issues.orderBy(I.severity_rank(F.col("severity")), F.desc("count"), "code")


ISSUE_KEY = ("file_id", "code")
COLUMN_KEY = ("file_id", "code", "sheet", "col")
CHUNK_ROWS = 100_000


def number_occurrences(occurrences: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds ``n``: place of an occurrence in its issue, in report order.

    Column groups come first (sheet, then column), row-only findings last;
    rows ascend inside a group.  The place is the place inside the column
    group plus the sizes of the groups before it, so an issue with very many
    occurrences is never sorted in one task.
    """
    keys = list(COLUMN_KEY)
    inside = number_within(occurrences, keys, "row_no", "__k", width, nullable_keys=True)
    sizes = occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    order = Window.partitionBy(*ISSUE_KEY).orderBy(
        F.col("col").isNull(), F.coalesce("sheet", F.lit("")), "col"
    ).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, F.coalesce(F.sum("__size").over(order), F.lit(0)).alias("__base"))
    # One base row per column group: a group is as long as its column, so the
    # join is split by blocks of rows.
    blocked = inside.withColumn("__b", block_of(F.col("row_no"), width))
    spans = blocked.select(*keys, "__b").distinct()
    per_block = _null_safe_join(spans, bases, keys, "inner")
    joined = _null_safe_join(blocked, per_block, [*keys, "__b"], "inner")
    return joined.withColumn("n", F.col("__k") + F.col("__base")).drop("__k", "__base", "__b")


def cap_occurrences(occurrences: DataFrame, cap: int | None = None) -> DataFrame:
    """The occurrences a report stores: all, or the first ``cap`` of each issue.

    Counts are taken from the uncapped table; this only bounds what is located.
    """
    if cap is None:
        return occurrences
    return number_occurrences(occurrences).filter(F.col("n") <= cap).drop("n")


def positions(occurrences: DataFrame, file_id, code: str, offset: int = 0,
              limit: int = dims.MAX_POSITIONS) -> DataFrame:
    """One page of located occurrences: column groups first, then row-only."""
    wanted = occurrences.filter((F.col("file_id") == file_id) & (F.col("code") == code))
    return wanted.orderBy(
        F.col("col").isNull(), F.coalesce("sheet", F.lit("")), "col", "row_no"
    ).offset(max(0, offset)).limit(max(0, limit))


def affected_columns(occurrences: DataFrame) -> DataFrame:
    """Columns of each issue with their number of cases."""
    return occurrences.filter("col is not null").groupBy(*COLUMN_KEY, "field").agg(
        F.count(F.lit(1)).alias("cases"))


def issue_detail(issues: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Issues with where they are: columns affected (most cases first) and positions.

    Occurrences are counted per column before they meet the issues; the list
    is as long as the file has columns.
    """
    per_column = occurrences.groupBy(*COLUMN_KEY, "field").agg(F.count(F.lit(1)).alias("cases"))
    listed = F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), F.struct(
        (-F.col("cases")).alias("neg"), "sheet", "col", "field"))))
    per_issue = per_column.groupBy(*ISSUE_KEY).agg(F.sum("cases").alias("positions"), listed.alias("__c"))
    columns = F.transform("__c", lambda c: F.struct(
        c["sheet"].alias("sheet"), c["col"].alias("col"), c["field"].alias("field"), (-c["neg"]).alias("cases")))
    return issues.join(per_issue, list(ISSUE_KEY), "left").withColumns({
        "positions": F.coalesce("positions", F.lit(0).cast("bigint")), "columns": columns}).drop("__c")


def compact_occurrences(occurrences: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Delta-coded rows per column group, in chunks of at most ``width`` rows.

    Each chunk starts from an absolute row number and can be expanded on its
    own; a column with billions of findings becomes many chunks, never one
    array.  Cell text is kept only for the codes it says something about.
    """
    chunked = occurrences.withColumn("chunk", block_of(F.col("row_no"), width))
    order = Window.partitionBy(*COLUMN_KEY, "chunk").orderBy("row_no")
    kept = F.when(F.col("code").isin(*dims.CODES_WITH_CELL_VALUE), clip(F.col("cell")))
    coded = chunked.withColumns({
        "delta": F.col("row_no") - F.lag("row_no", 1, 0).over(order), "__cell": kept})
    grouped = coded.groupBy(*COLUMN_KEY, "chunk").agg(
        F.min("field").alias("field"),
        F.array_sort(F.collect_list(F.struct("row_no", "delta", F.col("__cell").alias("cell")))).alias("__s"),
    )
    has_cells = F.col("code").isin(*dims.CODES_WITH_CELL_VALUE)
    return grouped.select(
        *COLUMN_KEY, "chunk", "field",
        F.transform("__s", lambda s: s["delta"]).alias("rows"),
        F.when(has_cells, F.transform("__s", lambda s: s["cell"])).alias("cells"),
    )


def expand_occurrences(compact: DataFrame) -> DataFrame:
    """Back to one row per occurrence: a running sum inside each bounded chunk."""
    order = Window.partitionBy(*COLUMN_KEY, "chunk").orderBy("__pos").rowsBetween(
        Window.unboundedPreceding, 0)
    deltas = compact.select(*COLUMN_KEY, "chunk", "field", "cells", F.posexplode("rows").alias("__pos", "__d"))
    cell = F.get(F.col("cells"), F.col("__pos"))
    return deltas.select(
        *COLUMN_KEY, "field", F.sum("__d").over(order).alias("row_no"), cell.alias("cell"))
