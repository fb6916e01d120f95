"""Column profiling over text cells.

``cells`` is the long form every tabular check works on:

    file_id, sheet, col (0-based), field, row_no (1-based, header = 1), raw

Only cells that exist are rows, so ragged input needs no padding.  Profiles
come out of a single value-frequency aggregation: equal texts are combined
before the shuffle, and the typing rules run once per distinct value instead
of once per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import cells as C
from sievework.functions.issues import lookup
from sievework.functions.numbers import round_half_up

KEY = ("file_id", "sheet", "col")
TYPES = ("number", "date", "bool", "str")


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Column]:
    """Text rendering of typed columns; fractions go through two fixed decimals."""
    types = dict(df.dtypes)
    out: dict[str, Column] = {}
    for name in columns or df.columns:
        value = F.col(name)
        if types[name] in ("double", "float"):
            value = value.cast("decimal(18,2)")
        elif types[name].startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd")
        out[name] = value.cast("string")
    return out


def table_cells(df: DataFrame, columns: dict[str, Column], row_no: Column | None = None,
                file_id: str = "table") -> DataFrame:
    """Cells of one regular table; no shuffle, one generated row per cell.

    Pass ``row_no`` only when positions are needed: profiles do without it.
    """
    entries = F.array(*[
        F.struct(F.lit(i).alias("col"), F.lit(name).alias("field"), value.alias("raw"))
        for i, (name, value) in enumerate(columns.items())
    ])
    keep = [row_no.alias("row_no")] if row_no is not None else []
    return df.select(*keep, F.inline(entries)).select(
        F.lit(file_id).alias("file_id"), F.lit("").alias("sheet"), "col", "field",
        *(["row_no"] if keep else []), "raw")


def value_counts(cells: DataFrame) -> DataFrame:
    """Frequency of each distinct text per column, with its type and values."""
    counts = cells.groupBy(*KEY, "field", "raw").agg(F.count(F.lit(1)).alias("n"))
    kind = counts.withColumn("v", C.strip(F.col("raw"))).withColumn("kind", C.stripped_type(F.col("v")))
    return kind.withColumns({
        "num": F.when(F.col("kind") == "number", C.stripped_number(F.col("v"))),
        "day": F.when(F.col("kind").isin("date", "str"), C.stripped_date(F.col("v"))),
    }).drop("v")


def column_stats(counts: DataFrame) -> DataFrame:
    """Type counts, distinct values and ranges: one row per column."""
    def n_of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"n_{kind}")

    filled = F.col("kind") != "empty"
    # ``field`` goes with the key: text in an aggregation buffer would force a sort.
    stats = counts.groupBy(*KEY, "field").agg(
        *[n_of(k) for k in (*TYPES, "empty")],
        F.count_if(filled).alias("distinct"),
        F.min("num").alias("min_num"), F.max("num").alias("max_num"),
        F.min("day").alias("min_day"), F.max("day").alias("max_day"),
    )
    return stats.withColumn(
        "filled", sum((F.col(f"n_{k}") for k in TYPES[1:]), F.col("n_number"))
    ).withColumns(majority())


def majority() -> dict[str, Column]:
    """Winner by count, then number < date < bool < str; and the runner-up's count."""
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"n_{k}")).alias("neg"), F.lit(dims.TYPE_RANK[k]).alias("rank"), F.lit(k).alias("kind"))
        for k in TYPES
    ]))
    first = F.get(ranked, F.lit(0))
    return {
        "majority": F.when(F.col("filled") == 0, "empty").otherwise(first.getField("kind")),
        "majority_n": -first.getField("neg"),
        "second_n": -F.get(ranked, F.lit(1)).getField("neg"),
    }


def flags_types() -> Column:
    """Does the column have a type firm enough to call other values errors?"""
    return (
        (F.col("filled") >= dims.MIN_VALUES_FOR_TYPE)
        & F.col("majority").isin("number", "date", "bool")
        & (F.col("majority_n") > F.col("second_n"))
    )


def flags_missing(rows: Column) -> Column:
    """Is the column filled well enough for an empty cell to be a defect?"""
    return (rows > 0) & (F.col("filled") / rows >= dims.MIN_FILL)


def column_profiles(stats: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Published profile.  ``rows`` (file_id, sheet, n_rows) counts the data rows;
    without it every row is taken to have every column."""
    if rows is not None:
        stats = stats.join(rows, ["file_id", "sheet"])
    else:
        stats = stats.withColumn("n_rows", F.col("filled") + F.col("n_empty"))
    nulls = F.col("n_rows") - F.col("filled")
    is_num, is_date = F.col("majority") == "number", F.col("majority") == "date"
    return stats.select(
        *KEY, F.col("field").alias("name"),
        lookup(F.col("majority"), dims.TYPE_DISPLAY, "string").alias("type"),
        nulls.alias("null_count"),
        F.when(F.col("n_rows") > 0, round_half_up(nulls / F.col("n_rows"), 4)).otherwise(0.0).alias("null_pct"),
        "distinct",
        F.when(is_num, F.col("min_num")).alias("min_num"), F.when(is_num, F.col("max_num")).alias("max_num"),
        F.when(is_date, F.col("min_day")).alias("min_date"), F.when(is_date, F.col("max_day")).alias("max_date"),
    )


def profile_table(df: DataFrame, columns: Sequence[str] | None = None, file_id: str = "table") -> DataFrame:
    """Profile of every column of a table."""
    cells = table_cells(df, as_text(df, columns), file_id=file_id)
    return column_profiles(column_stats(value_counts(cells)))


def schema_null_pct(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("file_id", "sheet").agg(F.avg("null_pct").alias("avg_null_pct"))


def sample_rows(rows: DataFrame, n: int = dims.SAMPLE_ROWS, cells: str = "tokens") -> DataFrame:
    """The first ``n`` data rows of each file by position, cells clipped."""
    return rows.filter((F.col("row_no") > 1) & (F.col("row_no") <= n + 1)).withColumn(
        cells, F.transform(cells, C.clip))
