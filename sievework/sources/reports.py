"""Report, checkpoint and export tables.

A report is two datasets: a light ``index`` (one row per file, no positions)
and the heavy ``detail``, split by the first two digits of the file id so that
a look-up by id reads one partition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import csv_line, file_key

RESULT_SCHEMA = """
  dataset_id STRING, idx INT, format STRING, mime STRING, url STRING, status STRING,
  fetch STRUCT<status: STRING, size: BIGINT, http_status: INT, truncated: BOOLEAN, note: STRING, final_url: STRING>,
  analysis STRUCT<ok: BOOLEAN, score: INT, summary: STRING, truncated: BOOLEAN,
    issues: ARRAY<STRUCT<code: STRING, label: STRING, severity: STRING, count: BIGINT, stored: BIGINT, source: STRING,
      columns: ARRAY<STRUCT<sheet: STRING, col: INT, field: STRING, rows: ARRAY<BIGINT>, cells: ARRAY<STRING>>>,
      rows: ARRAY<BIGINT>, samples: ARRAY<STRUCT<row: BIGINT, field: STRING, cell: STRING>>>>,
    schema: ARRAY<STRUCT<name: STRING, type: STRING, null_count: BIGINT, null_pct: DOUBLE, distinct: BIGINT>>,
    sample_rows: ARRAY<ARRAY<STRING>>, header: ARRAY<STRING>>
"""

#: Results in one file of a checkpoint.
RESULTS_PER_FILE = 200_000


def _as_struct(ddl: str) -> str:
    """Top-level ``name TYPE`` list as the fields of a STRUCT."""
    out, depth, token = [], 0, ""
    for ch in ddl.strip():
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(token)
            token = ""
        else:
            token += ch
    out.append(token)
    return ", ".join(re.sub(r"^(\w+)\s+", r"\1: ", t.strip()) for t in out)


CHECKPOINT_SCHEMA = f"url STRING, result STRUCT<{_as_struct(RESULT_SCHEMA)}>"


def issue_summary(issue: Column) -> Column:
    """An issue without its positions."""
    return issue.dropFields("columns", "rows", "samples")


def normalize_issues(results: DataFrame) -> DataFrame:
    """Old reports: ``stored`` from the length of the sample, id from the address."""
    issues = F.transform("analysis.issues", lambda i: i.withField(
        "stored", F.coalesce(i["stored"], F.when(F.size(i["samples"]) >= 0, F.size(i["samples"]).cast("bigint")),
                             F.lit(0).cast("bigint"))))
    out = results.withColumn("analysis", F.when(
        F.col("analysis").isNotNull(), F.col("analysis").withField("issues", issues)))
    key = file_key(F.coalesce("url", F.lit("")))
    return out.withColumn("id", F.coalesce("id", key) if "id" in results.columns else key)


def _has_detail() -> Column:
    a = F.col("analysis")
    return F.coalesce(
        (F.coalesce(F.size(a["schema"]), F.lit(0)) > 0) | (F.coalesce(F.size(a["sample_rows"]), F.lit(0)) > 0)
        | F.exists(a["issues"], lambda i: F.coalesce(i["stored"], F.lit(0)) > 0),
        F.lit(False))


def to_index(results: DataFrame) -> DataFrame:
    """Light rows: no profile, no sample rows, no positions."""
    slim = F.col("analysis").dropFields("schema", "sample_rows").withField(
        "issues", F.transform("analysis.issues", issue_summary))
    return results.withColumns({
        "id": file_key(F.coalesce("url", F.lit(""))), "has_detail": _has_detail(),
        "analysis": F.when(F.col("analysis").isNotNull(), slim)})


def to_detail(results: DataFrame) -> DataFrame:
    """Heavy rows: header once, profile, samples, and only the located issues."""
    a = F.col("analysis")
    return results.filter(_has_detail()).select(
        file_key(F.coalesce("url", F.lit(""))).alias("id"), "url", "format", "dataset_id",
        F.coalesce(a["header"], F.array().cast("array<string>")).alias("header"),
        F.filter(a["issues"], lambda i: i["stored"] > 0).alias("issues"),
        a["schema"].alias("schema"), a["sample_rows"].alias("sample_rows"))


def write_report(results: DataFrame, path: str) -> None:
    """Write index and detail; the previous report at the path is replaced.

    Details are dealt by prefix first, so that not every task writes a file for
    each prefix; AQE cuts up prefixes too large for one task, so small reports
    are one file a prefix and large ones as many as their size asks for.
    """
    to_index(results).write.mode("overwrite").parquet(f"{path}/index")
    detail = to_detail(results).withColumn("prefix", F.substring("id", 1, 2))
    detail.hint("rebalance", "prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/detail")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    # The partition column is text ("07"), so its type must not be guessed.
    written = spark.read.parquet(f"{path}/detail").schema
    fields = [f for f in written.fields if f.name != "prefix"]
    schema = T.StructType([*fields, T.StructField("prefix", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/detail")


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Result documents as JSON lines, old shapes brought up to date."""
    return normalize_issues(spark.read.schema(RESULT_SCHEMA + ", id STRING").json(path))


def detail_for(details: DataFrame, file_id: str) -> DataFrame:
    """The fragment of one file; an identifier of the wrong shape finds nothing."""
    if not re.fullmatch(r"[0-9a-f]{6,64}", file_id or ""):
        return details.limit(0)
    return details.filter((F.col("prefix") == file_id[:2]) & (F.col("id") == file_id))


def rebuild(index: DataFrame, details: DataFrame) -> DataFrame:
    """Index joined to detail; positions go back to their issue by code.

    A missing fragment is tolerated.  Ids repeat only where files share an
    address, and the fragment they share is one row.
    """
    # One row of each id by its number: the nested columns are sorted once, by the key of the join.
    turn = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    one = details.select("id", F.col("issues").alias("__i"), F.col("schema").alias("__s"), F.col("sample_rows").alias("__r"),
                         turn.alias("__turn")).filter("__turn = 1").drop("__turn")
    joined = index.join(one, "id", "left")
    located = F.transform("analysis.issues", lambda i: _with_positions(i))
    full = F.col("analysis").withField("issues", located).withField("schema", F.col("__s")).withField(
        "sample_rows", F.col("__r"))
    return joined.withColumn("analysis", F.when(F.col("analysis").isNotNull(), full)).drop("__i", "__s", "__r")


def _with_positions(issue: Column) -> Column:
    match = F.get(F.filter(F.col("__i"), lambda d: d["code"] == issue["code"]), F.lit(0))
    return issue.withField("columns", match["columns"]).withField("rows", match["rows"])


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Last result per address of a JSON-lines checkpoint; bad lines are skipped."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("ord"))
    parsed = lines.select("f", "ord", F.from_json("value", CHECKPOINT_SCHEMA).alias("e"))
    good = parsed.filter("coalesce(e.url, '') <> '' and e.result is not null")
    return good.groupBy(F.col("e.url").alias("url")).agg(
        F.max_by("e.result", F.struct("f", "ord")).alias("result"))


def write_checkpoint(results: DataFrame, path: str, skip_urls: DataFrame | None = None) -> None:
    """All results but those at the skipped addresses, as compressed JSON lines.

    A compressed file is read by one task, so none holds more than a bounded number of results.
    """
    kept = results if skip_urls is None else results.join(skip_urls.select("url").distinct(), "url", "left_anti")
    kept.select("url", "result").write.mode("overwrite").option("maxRecordsPerFile", RESULTS_PER_FILE).json(path, compression="gzip")


def csv_lines(df: DataFrame, header: list[str], columns: list[Column], delimiter: str = ";") -> DataFrame:
    """Export lines, the header (with its byte-order mark) before the first of each part."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.lit("﻿" + delimiter.join(header) + "\r\n")
    line = csv_line(columns, delimiter)
    return df.select(F.when(first, F.concat(head, line)).otherwise(line).alias("value"))


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, delimiter: str = ";") -> None:
    """Spreadsheet-safe CSV; every part file opens on its own, and an empty table gives its header."""
    names = columns or df.columns
    lines = csv_lines(df, names, [F.col(c).cast("string") for c in names], delimiter)
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        head = spark.range(1).select(F.lit("\ufeff" + delimiter.join(names)).alias("value"))
        head.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)
