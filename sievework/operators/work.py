"""Work lists: what fails, why, where it repeats, and what to repair first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.functions import issues as I
from sievework.functions.text import contains_text, format_slug
from sievework.operators.groups import join_by_key, number_within


def file_slugs(files: DataFrame) -> DataFrame:
    """Adds ``slug``: the format, with ``-n`` from its second file in the dataset on."""
    ranked = number_within(files.withColumn("__base", format_slug(F.col("format"))),
                           ["dataset_id", "__base"], "idx", "__k")
    suffix = F.when(F.col("__k") > 1, F.concat(F.lit("-"), F.col("__k").cast("string"))).otherwise("")
    return ranked.withColumn("slug", F.concat("__base", suffix)).drop("__base", "__k")


def resolve_file(slugged: DataFrame, dataset_id, param: str) -> DataFrame:
    """A file by slug, or by its position when the address is a number."""
    wanted = F.col("idx") == int(param) if param.isascii() and param.isdigit() else F.col("slug") == param.lower()
    return slugged.filter((F.col("dataset_id") == dataset_id) & wanted)


def file_issue_rows(files: DataFrame, datasets: DataFrame | None = None,
                    counts: DataFrame | None = None) -> DataFrame:
    """One row per file with a defect.

    ``entrega``: the file is not in order, explained by its cause.
    ``contenido``: it opens and carries error issues; all their codes are kept.
    ``files`` needs state, cause, codes and ``error_codes`` (non-blocking error
    codes in report order).  ``counts`` are the files per dataset, when known
    from a cheaper table than the classified one.
    """
    opens = F.col("state") == "ok"
    rows = files.filter(~opens | (F.size("error_codes") > 0)).withColumns({
        "family": F.when(opens, "contenido").otherwise("entrega"),
        "cause_code": F.when(opens, F.get("error_codes", F.lit(0))).otherwise(
            F.coalesce("cause", F.lit(dims.UNKNOWN_CAUSE))),
        "cause_codes": F.when(opens, F.col("error_codes")).otherwise(
            F.array(F.coalesce("cause", F.lit(dims.UNKNOWN_CAUSE)))),
        "error_issues": F.when(opens, F.size("error_codes")),
    })
    if datasets is not None:
        rows = join_by_key(rows, datasets.select("dataset_id", "title", "category"),
                           ["dataset_id"], "file_id", counts=counts)
    return rows


def filter_file_issues(
    rows: DataFrame, family: str | None = None, fmt: str | None = None,
    category: str | None = None, causes: Sequence[str] = (), text: str | None = None,
) -> DataFrame:
    out = rows
    if family:
        out = out.filter(F.col("family") == family)
    if fmt:
        out = out.filter(F.col("format") == fmt)
    if category:
        out = out.filter(F.col("category") == category)
    if causes:
        out = out.filter(D.matches_causes(F.col("cause_code"), F.col("cause_codes"), list(causes)))
    if text and text.strip():
        out = out.filter(contains_text(text.strip(), F.col("title"), F.col("category"),
                                       F.col("format"), F.col("url"), separator=" "))
    return out


def facets(rows: DataFrame, active: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Counts per family, plus the commonest causes and any that are in use."""
    families = rows.groupBy(F.col("family").alias("value")).agg(F.count(F.lit(1)).alias("files")).select(
        F.lit("family").alias("facet"), "value", "files")
    causes = rows.select(F.explode("cause_codes").alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("files")).select(F.lit("cause").alias("facet"), "value", "files")
    kept = causes if top is None else causes.orderBy(F.desc("files"), "value").limit(top)
    if active and top is not None:
        kept = kept.union(causes.filter(F.col("value").isin(*active))).distinct()
    return families.unionByName(kept)


def format_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("format").agg(F.count(F.lit(1)).alias("format_total"))


def systemic_causes(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Delivery failures by format and cause; does a cause take a whole format?

    Aggregated per dataset first: the distinct count of datasets becomes a
    plain count and no group is larger than the number of datasets.
    """
    grouped = (
        rows.groupBy("format", "cause_code", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("format", "cause_code").agg(
            F.sum("n").alias("affected"), F.count(F.lit(1)).alias("datasets"))
    )
    joined = grouped.join(totals, "format", "left").withColumn(
        "format_total", F.coalesce("format_total", "affected"))
    whole = (F.col("format_total") > 1) & (F.col("affected") == F.col("format_total"))
    return joined.select(
        F.concat_ws("|", "format", "cause_code").alias("key"), "format", "cause_code",
        I.issue_label(F.col("cause_code")).alias("cause_label"),
        "affected", "format_total", "datasets", whole.alias("whole_format"),
    ).orderBy(F.desc("whole_format"), F.desc("affected"), "key")


def group_by_field(rows: DataFrame, field: str) -> DataFrame:
    """Failures and datasets per category or format."""
    value = F.when(F.coalesce(F.col(field), F.lit("")) == "", dims.UNCLASSIFIED).otherwise(F.col(field))
    return (
        rows.groupBy(value.alias("value"), "dataset_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value").agg(F.sum("n").alias("affected"), F.count(F.lit(1)).alias("datasets"))
        .orderBy(F.desc("affected"), "value")
    )


def failures_by_category(rows: DataFrame, datasets: DataFrame) -> DataFrame:
    """Same by dataset category, joining after the counts per dataset."""
    per_dataset = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_dataset.join(datasets.select("dataset_id", "category"), "dataset_id", "left")
    value = F.when(F.coalesce("category", F.lit("")) == "", dims.UNCLASSIFIED).otherwise(F.col("category"))
    return joined.groupBy(value.alias("value")).agg(
        F.sum("n").alias("affected"), F.count(F.lit(1)).alias("datasets")
    ).orderBy(F.desc("affected"), "value")


def group_by_cause(rows: DataFrame) -> DataFrame:
    """Failures per cause; a row with several causes counts in each."""
    exploded = rows.select("dataset_id", F.explode("cause_codes").alias("code"))
    return (
        exploded.groupBy("code", "dataset_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("code").agg(F.sum("n").alias("affected"), F.count(F.lit(1)).alias("datasets"))
        .orderBy(F.desc("affected"), "code")
    )


def alerts(by_code: DataFrame, scored: DataFrame) -> DataFrame:
    """Datasets that need attention, with their causes, blocking ones first.

    ``by_code``: (dataset_id, code, cases); ``scored``: (dataset_id, title,
    content, composite, files, failed).  Causes per dataset are bounded by the
    code vocabulary.
    """
    blocking = F.col("code").isin(*dims.BLOCKING_CODES)
    relevant = by_code.filter(
        blocking | F.col("code").isin(*dims.HIGH_IMPACT_CODES)
        | ((F.col("code") == "celda-faltante") & (F.col("cases") >= dims.MISSING_CELL_ALERT))
    )
    causes = relevant.groupBy("dataset_id").agg(
        F.max(blocking).alias("has_blocking"),
        F.array_sort(F.collect_list(F.struct(
            F.when(blocking, 0).otherwise(1).alias("rank"), (-F.col("cases")).alias("neg"), "code"
        ))).alias("__c"),
    ).select(
        "dataset_id", "has_blocking",
        F.transform("__c", lambda c: F.struct(c["code"].alias("code"), (-c["neg"]).alias("cases"))).alias("causes"),
    )
    critical = F.col("has_blocking") | F.coalesce(F.col("content") < dims.SCORE_WARN, F.lit(False))
    return causes.join(scored, "dataset_id").withColumn(
        "level", F.when(critical, "critical").otherwise("warning"))


def worst_first(alerted: DataFrame, score: str = "composite", limit: int | None = None) -> DataFrame:
    """The alert list as shown: unknown scores first, then the lowest; all of it, or the first ``limit``."""
    ordered = alerted.orderBy(F.asc_nulls_first(score), "dataset_id")
    return ordered if limit is None else ordered.limit(limit)


def alert_summary(alerted: DataFrame) -> DataFrame:
    """Totals by level and by category of cause."""
    def in_category(name: str):
        return F.exists("causes", lambda c: I.issue_category(c["code"]) == name)

    return alerted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("level") == "critical").alias("critical"),
        F.count_if(F.col("level") == "warning").alias("warning"),
        *[F.count_if(in_category(c)).alias(c) for c in ("availability", "format", "content")],
    )


_ACTION_COLUMNS = ("key", "family", "title", "action", "affected", "unit", "datasets",
                   "scope_total", "format", "whole_format")


def delivery_actions(causes: DataFrame) -> DataFrame:
    return causes.select(
        F.concat(F.lit("entrega:"), "key").alias("key"), F.lit("entrega").alias("family"),
        F.concat(F.col("cause_label"), F.lit(" · "), F.col("format")).alias("title"),
        I.lookup(F.col("cause_code"), dims.DELIVERY_ACTIONS, dims.DEFAULT_DELIVERY_ACTION).alias("action"),
        "affected", F.lit("archivos").alias("unit"), "datasets",
        F.col("format_total").alias("scope_total"), "format", "whole_format",
    )


def content_actions(by_issue: DataFrame) -> DataFrame:
    known = by_issue.filter(F.col("code").isin(*dims.CONTENT_ACTIONS)
                            & ~F.col("code").isin(*dims.BLOCKING_CODES))
    return known.select(
        F.concat(F.lit("contenido:"), "code").alias("key"), F.lit("contenido").alias("family"),
        I.issue_label(F.col("code")).alias("title"),
        I.lookup(F.col("code"), dims.CONTENT_ACTIONS).alias("action"),
        F.col("files").alias("affected"), F.lit("archivos").alias("unit"),
    )


def metadata_actions(gap_counts: DataFrame) -> DataFrame:
    """Actions for metadata gaps (code, datasets); recommendations are not repairs."""
    info = dims.METADATA_GAPS
    code = F.col("code")
    axis = I.lookup(code, {k: v[2] for k, v in info.items()})
    title = I.lookup(code, {k: f"{v[0]} ({v[1]})" for k, v in info.items()})
    return gap_counts.filter(axis != "recomendacion").select(
        F.concat(F.lit("metadatos:"), code).alias("key"), F.lit("metadatos").alias("family"),
        title.alias("title"), I.lookup(code, {k: v[3] for k, v in info.items()}).alias("action"),
        F.col("datasets").alias("affected"), F.lit("conjuntos de datos").alias("unit"),
    )


def repair_actions(*families: DataFrame) -> DataFrame:
    """Union of the three families in repair order."""
    out = families[0]
    for family in families[1:]:
        out = out.unionByName(family, allowMissingColumns=True)
    for column in _ACTION_COLUMNS:
        if column not in out.columns:
            out = out.withColumn(column, F.lit(None))
    out = out.withColumn("whole_format", F.coalesce("whole_format", F.lit(False)))
    priority = I.lookup(F.col("family"), dims.FAMILY_PRIORITY)
    return out.select(*_ACTION_COLUMNS).orderBy(
        F.desc("whole_format"), priority, F.desc("affected"), F.collate("title", "es"), "key")


def dictionary_encode(df: DataFrame, text: str, position: str, out: str = "note_id",
                      max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Repeated notes to small ids, in order of first appearance.

    Returns (rows with ids, note table).  Ids come from numbering the notes by
    the position of their first row, which is unique.
    """
    note = F.col(text) if max_chars is None else F.substring(F.col(text), 1, max_chars)
    noted = df.withColumn("__note", F.when(note != "", note))
    firsts = noted.filter("__note is not null").groupBy("__note").agg(F.min(position).alias("__first"))
    notes = number_within(firsts, [], "__first", out, sparse=True).select(
        F.col("__note"), (F.col(out) - 1).alias(out))
    coded = join_by_key(noted, notes, ["__note"], position).drop("__note")
    return coded, notes.withColumnRenamed("__note", "note")
