"""Locating defects in tables.

Findings share one shape: (file_id, code, sheet, col, field, row_no, cell).
Structural checks work on ``rows``: (file_id, sheet, row_no, tokens, header)
and need no shuffle; typed checks join cells to the verdict on their column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import cells as C
from sievework.functions.issues import score_outcome
from sievework.functions.json_text import computed
from sievework.operators import issues as IO
from sievework.operators import profile as P
from sievework.operators.groups import BLOCK_WIDTH, block_of, repeats

FINDING = ("file_id", "code", "sheet", "col", "field", "row_no", "cell")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def cell_defects(cells: DataFrame, stats: DataFrame, rows: DataFrame | None = None,
                 columns: int | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Type mismatches and missing cells in one pass over the cells.

    ``columns`` is the number of audited columns when the caller knows it from
    a schema: that is a proven bound, so the verdicts are broadcast.  For a
    collection of files the verdicts are repeated per block of rows instead,
    and the join key (column, block) never gathers more than ``width`` cells.
    """
    if rows is not None:
        stats = stats.join(rows, ["file_id", "sheet"])
    else:
        stats = stats.withColumn("n_rows", F.col("filled") + F.col("n_empty"))
    verdicts = stats.select(
        *P.KEY, "majority", P.flags_types().alias("check_type"),
        P.flags_missing(F.col("n_rows")).alias("check_missing"),
        *(["last_row"] if "last_row" in stats.columns else []),
    ).filter("check_type or check_missing")
    # Typed below the join: a filter above it cannot be merged into the typing
    # and make the patterns run several times.
    cells = cells.withColumn("__v", C.strip(F.col("raw"))).withColumn("__kind", C.stripped_type(F.col("__v")))
    kind = F.col("__kind")
    if columns is not None:
        joined = cells.join(F.broadcast(verdicts), list(P.KEY))
    else:
        last = verdicts.withColumn("__block", F.explode(F.sequence(
            F.lit(0).cast("bigint"), block_of(F.col("last_row"), width))))
        joined = cells.withColumn("__block", block_of(F.col("row_no"), width)).join(
            last.drop("last_row"), [*P.KEY, "__block"])
    code = (
        F.when(kind == "empty", F.when(F.col("check_missing"), "celda-faltante"))
        .when(F.col("check_type") & (kind != F.col("majority")), "error-tipo")
    )
    found = joined.withColumn("code", code).filter("code is not null")
    return found.select(
        "file_id", "code", "sheet", "col", "field", "row_no",
        F.when(F.col("code") == "error-tipo", F.col("raw")).alias("cell"))


def last_rows(cells: DataFrame) -> DataFrame:
    """Last row of each column, for the block bounds of ``cell_defects``."""
    return cells.groupBy(*P.KEY).agg(F.max("row_no").alias("last_row"))


def _finding(code: str, col: Column, field: Column, cell: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), col.cast("int").alias("col"),
                    field.cast("string").alias("field"), cell.cast("string").alias("cell"))


def _blank_row() -> Column:
    return F.forall("tokens", C.is_blank)


def row_findings(rows: DataFrame) -> DataFrame:
    """Short, long and blank rows in one pass over the rows, without a shuffle.

    A short row lacks cells against the header (one finding each), a long one
    has surplus cells (one finding each), a blank row is one finding.
    """
    n, width = F.size("tokens"), F.size("header")
    blank, nothing = _blank_row(), F.lit(None)
    missing = F.transform(
        F.when((n < width) & ~blank, F.sequence(n, width - 1)),
        lambda c: _finding("celda-faltante", c, F.get(F.col("header"), c), nothing))
    surplus = F.transform(
        F.when(n > width, F.slice("tokens", width + 1, n - width)),
        lambda cell, p: _finding("celda-extra", F.size("header") + p, nothing, cell))
    empty = F.when(blank, F.array(_finding("fila-vacia", nothing, nothing, nothing)))
    none = F.array().cast("array<struct<code:string,col:int,field:string,cell:string>>")
    found = F.concat(*[F.coalesce(part, none) for part in (missing, surplus, empty)])
    return rows.select("file_id", "sheet", "row_no", F.inline(found)).select(*FINDING)


def short_rows(rows: DataFrame) -> DataFrame:
    return row_findings(rows).filter("code = 'celda-faltante'")


def extra_cells(rows: DataFrame) -> DataFrame:
    return row_findings(rows).filter("code = 'celda-extra'")


def blank_rows(rows: DataFrame) -> DataFrame:
    return row_findings(rows).filter("code = 'fila-vacia'")


def header_labels(headers: DataFrame) -> DataFrame:
    """One row per column label: (file_id, sheet, col, label)."""
    return headers.select("file_id", "sheet", F.posexplode("header").alias("col", "label"))


def blank_labels(headers: DataFrame) -> DataFrame:
    """Columns without a name, or with one a reader made up for them."""
    label = F.col("label")
    return header_labels(headers).filter(C.is_blank(label) | label.rlike(r"^Columna [0-9]+$")).select(
        "file_id", F.lit("encabezado-vacio").alias("code"), "sheet", "col",
        label.alias("field"), F.lit(1).cast("bigint").alias("row_no"), label.alias("cell"))


def duplicate_labels(headers: DataFrame) -> DataFrame:
    """Second and later columns of the same name (trimmed, any case).

    Works inside the header array: sorted by name and column, a repeat follows
    a column of its name.
    """
    ordered = F.array_sort(F.transform("header", lambda h, i: F.struct(
        F.lower(C.strip(h)).alias("name"), i.alias("col"), h.alias("label"))))
    sorted_once = computed(headers.select("file_id", "sheet", "header"), {"__o": ordered})
    repeats_only = F.filter("__o", lambda e, i: (e["name"] != "") & (F.get(F.col("__o"), i - 1)["name"] == e["name"]))
    return sorted_once.select("file_id", "sheet", F.inline(repeats_only)).select(
        "file_id", F.lit("encabezado-duplicado").alias("code"), "sheet", "col",
        F.col("label").alias("field"), F.lit(1).cast("bigint").alias("row_no"), F.col("label").alias("cell"))


def duplicate_rows(df: DataFrame, content: Sequence[Column], position: str) -> DataFrame:
    """Rows whose whole content already occurred earlier in the table.

    Long content travels as its SHA-256; the first row of each content is a
    map-side minimum, so a group of copies of any size costs nothing extra.
    """
    # Each cell with its length before it, null as a cell of no length: no two contents look alike.
    cells = [F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in content]
    keyed = df.withColumn("__content", F.sha2(F.concat(*cells).cast("binary"), 256))
    return repeats(keyed, ["__content"], position).drop("__content")


def unique_violations(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """Rows repeating a key that should be unique; keys with nulls never clash."""
    complete = df.dropna(subset=list(columns))
    return repeats(complete, columns, position)


def constraint_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking a rule, one row per broken rule; an unknown outcome passes."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def encoding_errors(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that are not valid UTF-8, or that carry the replacement character."""
    bad = ~F.is_valid_utf8(F.col(value)) | F.col(value).contains("�")
    return lines.filter(bad)


def findings_of(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """All structural findings of delimited files (data rows and headers)."""
    return row_findings(rows).unionByName(blank_labels(headers)).unionByName(duplicate_labels(headers))


def table_row_cells(data: DataFrame) -> DataFrame:
    """Cells of ragged rows, those beyond the header included: they are named by their place."""
    name = F.coalesce(F.get(F.col("header"), F.col("col")), F.concat(F.lit("Col "), (F.col("col") + 1).cast("string")))
    return data.select("file_id", "sheet", "row_no", F.size("header").alias("width"), "header", F.posexplode("tokens").alias("col", "raw")).select(
        "file_id", "sheet", "col", name.alias("field"), "row_no", "raw", "width")


def audit_rows(rows: DataFrame, headers: DataFrame, width: int = BLOCK_WIDTH, shaped: str | None = None) -> dict[str, DataFrame]:
    """Full audit of ragged tables: profiles, findings, issues and file scores.

    One aggregation over the cells yields profiles and verdicts; findings are
    row-local or meet the verdicts by (column, block of rows).  The parsed rows
    are read four times, so hand in a written table when parsing is costly.
    Profiles reach to the widest row of each file; cells beyond the header are
    surplus and not judged by type.

    ``shaped`` names a flag of the rows: where it is false, rows come from
    records, whose shape is no defect and of which none is left out.
    """
    judged = F.lit(True) if shaped is None else F.col(shaped)
    data = rows.filter(~judged | ~_blank_row())
    cells = table_row_cells(data if shaped is None else data.withColumn(
        "tokens", F.when(F.col(shaped), F.col("tokens")).otherwise(F.slice("tokens", 1, F.greatest(F.size("header"), F.lit(1))))))
    counts = P.value_counts(cells)
    row_counts = data.groupBy("file_id", "sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_no").alias("last_row"))
    stats = P.column_stats(counts)
    within = cells.filter(F.col("col") < F.col("width")).drop("width")
    own = (rows, headers) if shaped is None else (rows.filter(shaped), headers.filter(shaped))
    findings = findings_of(*own).unionByName(cell_defects(within, stats, row_counts, width=width))
    issues = IO.from_occurrences(findings)
    per_file = row_counts.groupBy("file_id").agg(F.sum("n_rows").alias("rows"))
    files = headers.groupBy("file_id").agg(F.max(F.size("header")).alias("columns")).join(per_file, "file_id", "left")
    scores = files.join(IO.score_files(issues), "file_id", "left").join(
        error_cells(issues), "file_id", "left")
    return {
        "profiles": P.column_profiles(stats, row_counts.drop("last_row")),
        "findings": findings,
        "issues": issues,
        "files": score_outcome(scores),
    }


def audit_cells(cells: DataFrame, width: int = BLOCK_WIDTH) -> dict[str, DataFrame]:
    """Audit of workbook cells in long form; each sheet is judged on its own.

    ``cells`` hold data cells (header excluded).  Rows without any content are
    left out, as are sheets without data rows.
    """
    filled_rows = cells.filter(~C.is_blank(F.col("raw"))).select("file_id", "sheet", "row_no").distinct()
    data = cells.join(filled_rows, ["file_id", "sheet", "row_no"], "left_semi")
    stats = P.column_stats(P.value_counts(data))
    row_counts = filled_rows.groupBy("file_id", "sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_no").alias("last_row"))
    findings = cell_defects(data, stats, row_counts, width=width)
    issues = IO.from_occurrences(findings)
    per_file = row_counts.groupBy("file_id").agg(
        F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("sheets"))
    scores = per_file.join(IO.score_files(issues), "file_id", "left").join(error_cells(issues), "file_id", "left")
    profiles = P.column_profiles(stats, row_counts.drop("last_row"))
    first_sheet = row_counts.groupBy("file_id").agg(F.min("sheet").alias("sheet"))
    return {
        "profiles": profiles.join(first_sheet, ["file_id", "sheet"]),
        "findings": findings, "issues": issues, "files": score_outcome(scores),
    }


def audit_records(rows: DataFrame, width: int = BLOCK_WIDTH) -> dict[str, DataFrame]:
    """Audit of JSON records as rows: typed checks only, their shape being no defect.

    ``rows``: (file_id, row_no, header, tokens).
    """
    cells = rows.select(
        "file_id", F.lit("").alias("sheet"), "row_no", "header", F.posexplode("tokens").alias("col", "raw")
    ).filter(F.col("col") < F.size("header")).select(
        "file_id", "sheet", "col", F.get(F.col("header"), F.col("col")).alias("field"), "row_no", "raw")
    stats = P.column_stats(P.value_counts(cells))
    row_counts = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_no").alias("last_row")).withColumn("sheet", F.lit(""))
    findings = cell_defects(cells, stats, row_counts, width=width)
    issues = IO.from_occurrences(findings)
    scores = row_counts.select("file_id", F.col("n_rows").alias("rows")).join(
        IO.score_files(issues), "file_id", "left").join(error_cells(issues), "file_id", "left")
    return {"profiles": P.column_profiles(stats, row_counts.drop("last_row")), "findings": findings,
            "issues": issues, "files": score_outcome(scores)}


def error_cells(issues: DataFrame) -> DataFrame:
    """Cells in error: wrong type plus missing."""
    cases = F.sum(F.when(F.col("code").isin("error-tipo", "celda-faltante"), F.col("count")).otherwise(0))
    return issues.groupBy("file_id").agg(cases.alias("error_cells"))
