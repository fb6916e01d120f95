"""Work inside groups of any size.

A third of all rows may share one key, so nothing here lets one group end up
in one task.  Two devices are used throughout:

* **Blocks.** A group whose rows carry an integer position that is unique
  inside the group is cut into blocks of ``width`` positions.  A block holds
  at most ``width`` rows by construction, whatever the size of the group.
* **Hot keys.** When a large table meets a table with one row per key, the
  keys that more than ``hot_rows`` rows share (at most total/hot_rows of them)
  are spread over several tasks and the single row is repeated for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 1_000_000
HOT_ROWS = 2_000_000
_BLOCK, _BASE, _SALT, _HOT = "__block", "__rows_before", "__salt", "__hot"


def block_of(position: Column, width: int = BLOCK_WIDTH) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def _earlier_blocks(counts: DataFrame, keys: list[str], sparse: bool) -> DataFrame:
    """Sum over the earlier blocks of the group: (keys, block, rows before).

    Dense positions (row numbers, sequence ids) give few blocks, ordered in one
    window per group.  With sparse ids a group may have about as many blocks as
    rows, so the blocks are put into blocks themselves: two levels of a million
    cover the whole range of a BIGINT with windows of a few million rows.
    """
    def before(*partition: str):
        return Window.partitionBy(*partition)

    if not sparse:
        order = before(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*keys, _BLOCK, F.coalesce(F.sum("__n").over(order), F.lit(0)).alias(_BASE))
    upper = counts.withColumn("__upper", block_of(F.col(_BLOCK)))
    totals = upper.groupBy(*keys, "__upper").agg(F.sum("__n").alias("__t"))
    top = before(*keys).orderBy("__upper").rowsBetween(Window.unboundedPreceding, -1)
    tops = totals.select(*keys, "__upper", F.coalesce(F.sum("__t").over(top), F.lit(0)).alias("__top"))
    low = before(*keys, "__upper").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    lows = upper.withColumn("__low", F.coalesce(F.sum("__n").over(low), F.lit(0)))
    joined = _null_safe_join(lows, tops, [*keys, "__upper"], "inner")
    return joined.select(*keys, _BLOCK, (F.col("__low") + F.col("__top")).alias(_BASE))


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    out: str = "rn",
    width: int = BLOCK_WIDTH,
    nullable_keys: bool = False,
    sparse: bool = False,
) -> DataFrame:
    """1-based rank of each row inside its group, ordered by ``position``.

    ``position`` must be an integer, unique within the group.  The rank is the
    rank inside the row's block plus the rows of the earlier blocks; only the
    block counts are ever ordered group-wide.  An empty ``keys`` numbers the
    whole table.  Rows with a null key are lost unless ``nullable_keys``; say
    ``sparse`` when positions are ids far apart rather than running numbers.
    """
    keys = list(keys)
    blocked = df.withColumn(_BLOCK, block_of(F.col(position), width))
    counts = blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    bases = _earlier_blocks(counts, keys, sparse)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(position)
    ranked = blocked.withColumn(out, F.row_number().over(inside).cast("bigint"))
    # Plain equality reuses the window's partitioning; null keys need their own.
    if nullable_keys:
        joined = _null_safe_join(ranked, bases, [*keys, _BLOCK], "inner")
    else:
        joined = ranked.join(bases, [*keys, _BLOCK])
    return joined.withColumn(out, F.col(out) + F.col(_BASE)).drop(_BLOCK, _BASE)


def running_sum(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, width: int = BLOCK_WIDTH,
    sparse: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` in each group, ordered by ``position``.

    Same two levels as ``number_within``: inside blocks, plus the totals of
    the earlier blocks of the group.
    """
    keys = list(keys)
    blocked = df.withColumn(_BLOCK, block_of(F.col(position), width))
    sums = blocked.groupBy(*keys, _BLOCK).agg(F.sum(value).alias("__n"))
    bases = _earlier_blocks(sums, keys, sparse)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn(out, F.sum(value).over(inside))
    return summed.join(bases, [*keys, _BLOCK]).withColumn(out, F.col(out) + F.col(_BASE)).drop(_BLOCK, _BASE)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cluster, for costly work per row.

    Small rows compress well, so a table of very many may be a few input splits
    or even one.  The number of tasks is left to AQE: as many as there are
    cores, more where the rows are larger.
    """
    return df.hint("rebalance")


def first_rows(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Position of the first row of each group: a plain minimum, combined map-side."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))


def repeats(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Rows that are not the first of their group.

    ``position`` must be unique in the table.  The first rows are found by
    aggregation and taken away by an anti join on that unique position, so the
    join key never repeats however large a group of copies is.
    """
    firsts = first_rows(df, keys, position).select(position)
    return df.join(firsts, position, "left_anti")


def join_by_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    row_id: str,
    how: str = "left",
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    spread: int | None = None,
) -> DataFrame:
    """Join a large table to a table holding one row per key.

    A key shared by n > ``hot_rows`` rows is spread over n / ``hot_rows`` tasks,
    so a task's share stays the same however large the key grows (or over
    ``spread`` tasks where that is given).  How the few
    hot keys and the rows meet is left to Spark's own size estimates.

    ``counts`` (keys and ``n``) saves counting the rows of ``df`` when they, or
    those of a cheaper table with at least as many rows per key, are known.
    """
    keys = list(keys)
    counts = key_counts(df, keys) if counts is None else counts
    hot = counts.filter(F.col("n") > hot_rows).select(
        *keys,
        (F.ceil(F.col("n") / F.lit(hot_rows)) if spread is None else F.lit(spread)).cast("int").alias(_HOT))
    spread_of = F.pmod(F.xxhash64(row_id), F.col(_HOT)).cast("int")
    marked = df.join(hot, keys, "left").withColumn(
        _SALT, F.when(F.col(_HOT).isNotNull(), spread_of).otherwise(0)).drop(_HOT)
    salts = F.when(F.col(_HOT).isNotNull(), F.sequence(F.lit(0), F.col(_HOT) - 1)).otherwise(F.array(F.lit(0)))
    copies = per_key.join(hot, keys, "left").withColumn(_SALT, F.explode(salts)).drop(_HOT)
    return marked.join(copies, [*keys, _SALT], how).drop(_SALT)


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key as ``join_by_key`` takes them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys that may be null, keeping one copy of each key column."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
