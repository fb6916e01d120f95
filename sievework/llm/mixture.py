"""Mixing sources to target weights, exact to the word where the sizes allow it.

Each source's target is its weight's share of all words, stopped at
``most_epochs`` times the source's own size; what is cut off goes to the others
by weight until none is above.  A source gives all its documents as often as
its target holds them whole.  The remaining budget is a subset sum over counts
of documents by exact size: an even share of each size first, the largest
sizes that still fit next, and a bounded-knapsack dynamic program over what is
left.  The result is a number of documents per (source, size); which ones is
decided by a seeded hash.

Only counts are ever gathered per source, one row per distinct size.  Choosing
the documents of a size needs a rank among its (perhaps very many) documents:
they are cut into buckets of about ``BUCKET`` by hash, bucket counts say in
which bucket the choice ends, and only that one is ranked.

Defined cases: null text has size 0 and is never taken more often than the
epochs say; a null source is a source of its own, last in order; repeated rows
are documents of their own; an empty table gives an empty mix; sources without
words get target 0; other columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = 11
BUCKET = 4096
#: Words the dynamic program may be left with; its table has one cell per word.
CAPACITY = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> "F.Column":
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts per size (at most ``counts``) whose words come as near below ``budget`` as can be; budget <= CAPACITY.

    Each count is split in powers of two; ``by`` remembers the part that first
    reached a total, so totals are traced back without a table per part.
    """
    by = np.full(budget + 1, -1, np.int32)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for k in np.argsort(-sizes, kind="stable"):
        left, step = int(min(counts[k], budget // sizes[k])), 1
        while left > 0 and not reached[budget]:
            take = min(step, left)
            words = take * int(sizes[k])
            if words <= budget:
                new = np.zeros_like(reached)
                new[words:] = reached[:budget + 1 - words]
                new &= ~reached
                by[new] = len(parts)
                reached |= new
                parts.append((int(k), take))
            left -= take
            step *= 2
    chosen = np.zeros(len(sizes), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        k, take = parts[by[at]]
        chosen[k] += take
        at -= take * int(sizes[k])
    return chosen


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each size (0 to ``counts``) so that their words come near ``budget``."""
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts))
    chosen = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total == 0:
        return chosen
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    share = budget / total
    chosen = np.where(sizes > 0, np.floor(counts * share).astype(np.int64), 0)
    left = budget - sum(int(s) * int(c) for s, c in zip(sizes, chosen))
    # Leave the program the shorter half of its capacity to reach, take the largest sizes before it.
    for k in np.argsort(-sizes, kind="stable"):
        if left <= CAPACITY // 2 or sizes[k] == 0:
            break
        more = min(int(counts[k] - chosen[k]), (left - CAPACITY // 4) // int(sizes[k]))
        if more > 0:
            chosen[k] += more
            left -= more * int(sizes[k])
    fits = (sizes > 0) & (sizes <= min(left, CAPACITY)) & (counts > chosen)
    if left > 0 and fits.any():
        extra = _knapsack(sizes[fits], (counts - chosen)[fits], int(min(left, CAPACITY)))
        chosen[fits] += extra
        left -= int((extra * sizes[fits]).sum())
    # Or one document above: the target is a middle, not a limit.
    over = (sizes > 0) & (counts > chosen) & (sizes < 2 * left)
    if over.any():
        chosen[np.flatnonzero(over)[np.argmin(np.abs(sizes[over] - left))]] += 1
    return chosen


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, total_share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Places are given by one distributed sort; then sums over all sources are
    taken until no further target stops at its limit.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = spark.createDataFrame(ordered, "source string, source_size bigint, place bigint").select(
        "source", "source_size", F.element_at(cycle, (F.col("place") % len(weights)).cast("int") + 1).alias("weight"),
        (F.col("source_size") * most_epochs).cast("double").alias("limit"))
    placed, _ = written(placed, "sources")
    total = float(placed.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = 0.0
    while True:
        stopped = F.col("limit") <= F.col("weight") * level
        held, free = placed.agg(F.sum(F.when(stopped, F.col("limit"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        after = (total - (held or 0.0)) / free if free else level
        if not free or after <= level * (1 + 1e-12):
            break
        level = after
    return placed.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, copies, taken) of every row; taken = copies * size."""
    sized, _ = written(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("mark")), "sizes")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = written(counts, "counts")
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted, _ = written(targets(per_source, weights, most_epochs), "targets")

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        size, n = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        own, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        epochs = min(int(target // own), most_epochs) if own else 0
        extra = fit_counts(size, n, round(target - epochs * own)) if epochs < most_epochs else np.zeros(len(n), np.int64)
        return pd.DataFrame({
            "source": frame["source"], "size": size, "n": n, "epochs": epochs, "extra": extra,
            "source_size": own, "target": target})

    joined = counts.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    planned = joined.groupBy("source").applyInPandas(
        plan, "source string, size bigint, n bigint, epochs bigint, extra bigint, source_size bigint, target double")
    planned, _ = written(planned.withColumn("buckets", F.ceil(F.col("n") / F.lit(BUCKET)).cast("bigint")), "plan")

    # A seeded hash in [0, 2^32) puts a document into one of its size's buckets.
    draw = F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(1 << 32))
    right = planned.select(F.col("source").alias("s"), F.col("size").alias("z"), "epochs", "extra", "buckets", "source_size", "target")
    dealt = sized.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z").withColumn(
        "draw", draw).withColumn("bucket", F.floor(F.col("draw") * F.col("buckets") / F.lit(float(1 << 32))))
    dealt, _ = written(dealt, "dealt")
    open_rows = dealt.filter("extra > 0 and buckets > 1")
    filled = open_rows.groupBy("source", "size", "extra", "bucket").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = filled.withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0))).filter(
        (F.col("before") < F.col("extra")) & (F.col("before") + F.col("k") >= F.col("extra"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("last"), (F.col("extra") - F.col("before")).alias("rest"))
    marked = dealt.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    last = F.coalesce("last", F.lit(0))
    rest = F.coalesce("rest", F.col("extra"))
    border = (F.col("extra") > 0) & (F.col("bucket") == last)
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "doc_id", "mark"))
    shown = ["doc_id", "size", "source", "source_size", "target", "copies", "mark"]
    ranked = marked.filter(border).withColumn("copies", F.col("epochs") + F.when(rank <= rest, 1).otherwise(0)).select(*shown)
    plain = marked.filter(~border).withColumn(
        "copies", F.col("epochs") + F.when((F.col("extra") > 0) & (F.col("bucket") < last), 1).otherwise(0)).select(*shown)
    return ranked.unionByName(plain).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    taken = mix(docs, doc_id, text, source, **options).groupBy("doc_id", "source", "mark").agg(F.sum("copies").alias("__n"))
    taken = taken.filter("__n > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"), "__n")
    same = (F.col(doc_id).cast("bigint").eqNullSafe(F.col("__id")) & F.col(source).cast("string").eqNullSafe(F.col("__source"))
            & (F.xxhash64(F.col(text)) == F.col("__mark")))
    # Repeated rows are alike: the first stands for all of them.
    turn = F.row_number().over(Window.partitionBy("__id", "__source", "__mark").orderBy("__mark"))
    once = docs.join(taken, same).withColumn("__turn", turn).filter("__turn = 1")
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[docs[c] for c in docs.columns])
