"""Comparing runs: matching files to results, incremental plan, resume, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import file_key
from sievework.operators.groups import join_by_key, key_counts, number_within


def match_files(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Result of each catalogue file: by address first, then by position.

    Both sides carry dataset_id, idx (unique in the dataset) and url; results
    also ``result_id``.  The k-th file with an address takes the k-th result
    with it.  A file left over takes the result at its own position if nobody
    took that one.  Every join key is unique on both sides.
    """
    def ranked(df: DataFrame) -> DataFrame:
        return number_within(df, ["dataset_id", "url"], "idx", "k")

    files = ranked(catalog.select("dataset_id", "idx", "url"))
    found = ranked(results.select("dataset_id", "idx", "url", "result_id"))
    taken = found.select("dataset_id", "url", "k", F.col("result_id").alias("by_url"))
    first = files.join(taken, ["dataset_id", "url", "k"], "left")
    used = files.select("dataset_id", "url", "k")
    spare = found.join(used, ["dataset_id", "url", "k"], "left_anti").select(
        "dataset_id", "idx", F.col("result_id").alias("by_position"))
    second = first.join(spare, ["dataset_id", "idx"], "left")
    hit = F.coalesce("by_url", F.col("by_position"))
    how = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_position").isNotNull(), "position")
    return second.select("dataset_id", "idx", "url", hit.alias("result_id"), how.alias("matched_by"))


def resume_backlog(catalog: DataFrame, done: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Files still to analyse: those without a result, plus the forced ones.

    Results are keyed by (dataset_id, url): a shared address does not mark the
    files of another dataset as done.
    """
    keys = ["dataset_id", "url"]
    finished = done.select(*keys).distinct()
    if forced is not None:
        finished = finished.join(forced.select(*keys).distinct(), keys, "left_anti")
    return catalog.join(finished, keys, "left_anti")


def incremental_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """new / changed / same / removed for every dataset of either run.

    Files are compared by address; a fingerprint is (format, title).  When an
    address repeats in a dataset the last occurrence counts.
    """
    def deduped(df: DataFrame, side: str) -> DataFrame:
        mark = F.struct(F.col("format"), F.col("title"))
        return df.filter(F.col("url") != "").groupBy("dataset_id", "url").agg(
            F.max_by(mark, "idx").alias(f"{side}_mark"))

    both = deduped(current, "cur").join(deduped(previous, "prev"), ["dataset_id", "url"], "full_outer")
    in_cur, in_prev = F.col("cur_mark").isNotNull(), F.col("prev_mark").isNotNull()
    differs = ~F.col("cur_mark").eqNullSafe(F.col("prev_mark"))
    plan = both.groupBy("dataset_id").agg(
        F.count_if(in_cur).alias("urls"), F.count_if(in_prev).alias("previous_urls"),
        F.count_if(differs).alias("differences"),
    )
    status = (
        F.when(F.col("previous_urls") == 0, "new").when(F.col("urls") == 0, "removed")
        .when(F.col("differences") > 0, "changed").otherwise("same")
    )
    return plan.withColumn("plan", status)


def forced_urls(current: DataFrame, plan: DataFrame) -> DataFrame:
    """Every address of the new and changed datasets."""
    wanted = plan.filter(F.col("plan").isin("new", "changed")).select("dataset_id", "plan")
    addresses = current.filter(F.col("url") != "").select("dataset_id", "url", "file_id")
    return join_by_key(addresses, wanted, ["dataset_id"], "file_id", "inner").select("dataset_id", "url").distinct()


def last_results(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last result per key, as an aggregate: nothing is sorted or gathered."""
    others = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(
        F.max_by(F.struct(*others), order).alias("__last")).select(*keys, "__last.*")


def reseed_plan(files: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Which files cannot be reused from a report, and why.

    A file is analysed again when it carries one of the codes, has no address,
    or shares its address with another file.
    """
    with_url = files.filter(F.coalesce("url", F.lit("")) != "")
    shared = key_counts(with_url, ["url"]).filter("n > 1")
    marked = join_by_key(files, shared.select("url", F.col("n").alias("__n")), ["url"], "file_id", "left", shared)
    mine = F.coalesce(F.arrays_overlap("codes", F.array(*[F.lit(c) for c in codes])), F.lit(False))
    reason = (
        F.when(mine, "code").when(F.coalesce("url", F.lit("")) == "", "no_url")
        .when(F.col("__n").isNotNull(), "shared")
    )
    return marked.withColumn("reseed", reason).drop("__n")


def reseed_backlog(planned: DataFrame) -> DataFrame:
    return planned.filter("reseed is not null").groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("reseed") == "shared").alias("shared"),
        F.sum("size_bytes").alias("bytes"))


def rebuild_results(index: DataFrame, detail: DataFrame) -> DataFrame:
    """Index rows with their detail attached; a missing fragment is tolerated."""
    return index.join(detail.drop("url", "format", "dataset_id"), "id", "left")


def report_differences(old: DataFrame, new: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """missing / surplus / changed rows between two reports on a unique key."""
    a = old.select(F.col(key), F.struct(*compare).alias("old"))
    b = new.select(F.col(key), F.struct(*compare).alias("new"))
    kind = (
        F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "surplus")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return a.join(b, key, "full_outer").withColumn("difference", kind).filter(
        "difference is not null").select(key, "difference")


def with_file_key(files: DataFrame) -> DataFrame:
    return files.withColumn("id", file_key(F.coalesce("url", F.lit(""))))

