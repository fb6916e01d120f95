"""Catalogue side: filters, order, pages, statistics, metadata findings.

``catalog``: one row per dataset with dataset_id (the address), title,
description, license, publisher, category, keywords, formats, issued,
modified, metadata_score and, once ``diagnose`` ran, gaps and freshness.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import metadata as M
from sievework.functions import scores as S
from sievework.functions import text as T
from sievework.functions.issues import lookup
from sievework.functions.numbers import round_half_up


@dataclass(frozen=True)
class CatalogFilters:
    """Filters of a catalogue request, after normalisation."""

    categories: Sequence[str] = ()
    formats: Sequence[str] = ()
    licenses: Sequence[str] = ()
    date_from: str | None = None
    date_to: str | None = None
    query: str | None = None
    analysis: str | None = None
    geo: bool = False
    sort: str = dims.DEFAULT_SORT
    page: int = 1
    limit: int = dims.DEFAULT_PAGE_SIZE

    @classmethod
    def parse(cls, params: Mapping[str, str], strict_page_size: bool = True) -> "CatalogFilters":
        """From request parameters; anything unknown falls back to its default."""

        def items(key: str) -> tuple[str, ...]:
            return tuple(x.strip() for x in params.get(key, "").split(",") if x.strip())

        def number(key: str, default: int) -> int:
            digits = params.get(key, "").strip()
            return int(digits) if digits.lstrip("-").isdigit() and int(digits) != 0 else default

        limit = number("limit", dims.DEFAULT_PAGE_SIZE)
        if strict_page_size:
            limit = limit if limit in dims.PAGE_SIZES else dims.DEFAULT_PAGE_SIZE
        else:
            limit = min(max(limit, 1), dims.MAX_PAGE_SIZE)
        sort = params.get("sort", "")
        analysis = params.get("analisis", "")
        return cls(
            categories=items("categorias"), formats=items("formatos"), licenses=items("licencias"),
            date_from=params.get("desde") or None, date_to=params.get("hasta") or None,
            query=params.get("q", "").strip() or None,
            analysis=analysis if analysis in dims.ANALYSIS_STATES else None,
            geo=params.get("geo") == "1",
            sort=sort if sort in dims.SORTS else dims.DEFAULT_SORT,
            page=max(1, number("page", 1)), limit=limit,
        )

    @property
    def active(self) -> bool:
        return bool(self.categories or self.formats or self.licenses or self.date_from
                    or self.date_to or self.query or self.analysis or self.geo)


def _any_of(values: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]))


def filter_catalog(catalog: DataFrame, f: CatalogFilters) -> DataFrame:
    """Rows passing every active filter.

    ``analysis_state`` comes from the report; a dataset the report does not
    know counts as ``sin-datos``.
    """
    out = catalog
    if f.geo:
        out = out.filter(_any_of(F.col("formats"), dims.GEO_FORMATS))
    if f.categories:
        out = out.filter(F.col("category").isin(*f.categories))
    if f.formats:
        out = out.filter(_any_of(F.col("formats"), f.formats))
    if f.licenses:
        out = out.filter(F.col("license").isin(*f.licenses))
    day = F.substring(F.coalesce("issued", F.lit("")), 1, 10)
    if f.date_from:
        out = out.filter(day >= f.date_from)
    if f.date_to:
        out = out.filter(day <= f.date_to)
    if f.query:
        haystack = F.concat_ws(" ", "title", "description", "publisher", F.array_join("keywords", " "))
        out = out.filter(T.matches_query(haystack, f.query))
    if f.analysis:
        state = F.coalesce("analysis_state", F.lit("sin-datos"))
        out = out.filter(state == f.analysis)
    return out


def sort_columns(sort: str) -> list[Column]:
    """Sort keys; unknown scores go last both ways, the id breaks ties."""
    title = F.collate("title", "es")
    date = F.coalesce(F.when(F.col("modified") != "", F.col("modified")), F.col("issued"), F.lit(""))
    keys = {
        "quality-desc": [F.desc_nulls_last("composite"), title],
        "quality-asc": [F.asc_nulls_last("composite"), title],
        "title-asc": [title],
        "date-desc": [date.desc()],
        "date-asc": [date.asc()],
    }
    return [*keys[sort], F.col("dataset_id")]


def sort_catalog(catalog: DataFrame, sort: str) -> DataFrame:
    return catalog.orderBy(*sort_columns(sort))


def default_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("metadata_score"), F.collate("title", "es"), "dataset_id")


def catalog_page(catalog: DataFrame, f: CatalogFilters) -> tuple[DataFrame, dict[str, int]]:
    """One page and its numbers; a page past the end becomes the last one.

    The count is the only thing that reaches the driver; the page itself is a
    top-k, never a full sort.
    """
    hits = filter_catalog(catalog, f)
    total = hits.count()
    pages = max(1, -(-total // f.limit))
    page = min(max(f.page, 1), pages)
    rows = sort_catalog(hits, f.sort).offset((page - 1) * f.limit).limit(f.limit)
    return rows, {"total": total, "page": page, "limit": f.limit, "total_pages": pages}


def with_report(catalog: DataFrame, lite: DataFrame) -> DataFrame:
    """Catalogue joined to the per-dataset report view, with the shown score."""
    joined = catalog.join(lite, "dataset_id", "left")
    return joined.withColumn("composite", S.composite_score(
        F.col("metadata_score"), F.col("availability_pct"), F.col("score")))


def diagnose(catalog: DataFrame, now: Column) -> DataFrame:
    """Adds gaps, completeness, freshness and the metadata score, row by row."""
    c = F.col
    gaps = M.metadata_gaps(
        c("title"), c("description"), c("license"), c("publisher"), c("issued"), c("modified"), c("language"),
        c("spatial"), c("themes"), c("keywords"), c("periodicity"), c("formats"), c("identifier"), c("contact_point"))
    reference = M.reference_date(c("modified"), c("issued"))
    out = catalog.withColumns({
        "gaps": gaps,
        "freshness": M.freshness_diagnosis(c("modified"), c("issued"), c("periodicity"), now),
        "periods_late": M.periods_late(reference, c("periodicity"), now),
        "reference": M.reference_kind(c("modified"), c("issued")),
    })
    out = out.withColumns({
        "completeness": M.completeness_ratio(c("gaps")),
        "metadata_score": M.metadata_score(c("gaps"), c("formats"), c("modified"), c("issued"),
                                           c("periodicity"), c("license"), now),
    })
    ago = F.concat(F.when(c("reference") == "modified", "Actualizado ").otherwise("Publicado "),
                   T.time_ago(reference, now))
    return out.withColumns({
        "status": S.dataset_status(c("metadata_score")),
        "updated_ago": F.when(reference.isNull(), "Fecha desconocida").otherwise(ago),
    })


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Counts by category, licence, format and level, plus totals: (facet, value, n).

    A format counts once per dataset, whatever its number of files.
    """
    facets = F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("license").alias("facet"), F.col("license").alias("value")),
        F.struct(F.lit("status").alias("facet"), F.col("status").alias("value")),
    )
    formats = F.transform("formats", lambda f: F.struct(F.lit("format").alias("facet"), f.alias("value")))
    exploded = catalog.select(F.inline(F.concat(facets, formats)))
    return exploded.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def catalog_totals(catalog: DataFrame) -> DataFrame:
    """Datasets, files, mean metadata score and date range, as one row."""
    day = F.substring("issued", 1, 10)
    known = F.when(F.coalesce(day, F.lit("")) != "", day)
    return catalog.agg(
        F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
        F.coalesce(round_half_up(F.avg("metadata_score"), 1), F.lit(0.0)).alias("avg_score"),
        F.min(known).alias("first_day"), F.max(known).alias("last_day"))


def gap_groups(catalog: DataFrame) -> DataFrame:
    """Datasets per metadata gap, by axis and then by size."""
    info = dims.METADATA_GAPS
    grouped = catalog.select(F.explode("gaps").alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("datasets"))
    axis = lookup(F.col("code"), {k: v[2] for k, v in info.items()})
    return grouped.select(
        "code", lookup(F.col("code"), {k: v[0] for k, v in info.items()}).alias("label"),
        lookup(F.col("code"), {k: v[1] for k, v in info.items()}).alias("field"), axis.alias("axis"), "datasets",
    ).orderBy(lookup(F.col("axis"), dims.GAP_AXIS_ORDER), F.desc("datasets"), "code")


def gap_members(catalog: DataFrame) -> DataFrame:
    """(code, dataset) pairs behind the groups, as rows rather than lists."""
    return catalog.select(F.explode("gaps").alias("code"), "dataset_id", "title", "periods_late",
                          T.periodicity_label(F.col("periodicity")).alias("periodicity_label"))


def overdue(catalog: DataFrame) -> DataFrame:
    """Datasets past their update period, the latest first."""
    return catalog.filter("freshness = 'vencido'").orderBy(F.desc("periods_late"), "dataset_id")


def datasets_with_gaps(catalog: DataFrame) -> DataFrame:
    """How many datasets have a gap that is more than a recommendation."""
    minor = [k for k, v in dims.METADATA_GAPS.items() if v[2] == "recomendacion"]
    real = F.exists("gaps", lambda g: ~g.isin(*minor))
    return catalog.agg(F.count_if(real).alias("with_gaps"), F.count(F.lit(1)).alias("datasets"))


def new_since(catalog: DataFrame, analysed: DataFrame) -> DataFrame:
    """Datasets of the catalogue the report does not know yet."""
    return catalog.join(analysed.select("dataset_id").distinct(), "dataset_id", "left_anti")


def accept_refresh(new: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Should a refreshed catalogue replace the last good one?  One decision row.

    It must hold a plausible number of datasets and at least half of those of
    the last accepted one.
    """
    counts = new.agg(F.count(F.lit(1)).alias("new_rows"))
    if previous is None:
        counts = counts.withColumn("previous_rows", F.lit(None).cast("bigint"))
    else:
        tagged = new.select(F.lit("n").alias("side")).unionAll(previous.select(F.lit("p").alias("side")))
        counts = tagged.agg(F.count_if(F.col("side") == "n").alias("new_rows"),
                            F.count_if(F.col("side") == "p").alias("previous_rows"))
    shrunk = F.coalesce(F.col("new_rows") < F.col("previous_rows") * dims.MIN_RETENTION_RATIO, F.lit(False))
    reason = F.when(F.col("new_rows") < dims.MIN_PLAUSIBLE_DATASETS, "too-few").when(shrunk, "shrunk")
    return counts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def dataset_card(catalog: DataFrame, dataset_id) -> DataFrame:
    return catalog.filter(F.col("dataset_id") == dataset_id)


def by_publisher_name(catalog: DataFrame, needle: str) -> DataFrame:
    return catalog.filter(F.lower("publisher").contains(needle.lower()))


def sibling_services(files: DataFrame) -> DataFrame:
    """For each file, how many other services its dataset offers.

    Counted per dataset and joined back by key, not as pairs of files.
    """
    from sievework.operators.groups import join_by_key

    is_service = F.col("format").isin(*dims.SERVICE_FORMATS)
    per_dataset = files.groupBy("dataset_id").agg(F.count_if(is_service).alias("__s"), F.count(F.lit(1)).alias("n"))
    joined = join_by_key(files, per_dataset.drop("n"), ["dataset_id"], "file_id", "inner", per_dataset)
    return joined.withColumn("sibling_services", F.col("__s") - is_service.cast("int")).drop("__s")
