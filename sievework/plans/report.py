"""Report queries over the audit star, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.functions import issues as I
from sievework.functions import scores as S
from sievework.functions.text import duration_text, size_text
from sievework.operators import files as FO
from sievework.operators import rollup as R
from sievework.operators import work as W
from sievework.plans import star
from sievework.plans.star import STAR_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_map(column: str, table: dict, default: str | None = None) -> str:
    """SQL CASE for a closed dictionary (text values)."""
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    tail = "" if default is None else f" else '{default}'"
    return f"case {column} {whens}{tail} end"


def half_up(x: str, decimals: int = 0) -> str:
    if decimals == 0:
        return f"cast(floor(({x}) + 0.5) as bigint)"
    f = float(10**decimals)
    return f"(floor(({x}) * {f} + 0.5) / {f})"


def pct(part: str, whole: str, zero: str = "0") -> str:
    return f"case when ({whole}) > 0 then cast(floor(({part}) * 1.0::double / ({whole}) * 100 + 0.5) as bigint) else {zero} end"


COMPOSITE_SQL = (
    "case when availability is null then cast(metadata_score as bigint) "
    "else least(cast(floor(cast(metadata_score as double) * 0.4::double + availability * 0.3::double "
    "+ coalesce(content, 0) * 0.3::double + 0.5) as bigint), "
    "case when availability < 80 then 79 else 1000 end) end"
)
SCORED_SQL = STAR_SQL + f""",
dscore as (
  select dataset_id, count(*) as files,
         {half_up("avg(case when state = 'ok' then score end)")} as content,
         {pct("count(*) filter (where state = 'ok')", "count(*) filter (where state not in ('omitida','no-analizado'))", "null")} as availability
  from files group by dataset_id),
scored as (
  select ds.*, files, content, availability, {COMPOSITE_SQL} as composite
  from ds left join dscore using (dataset_id))"""


@register("dataset_scorecard", SCORED_SQL + """
select dataset_id, title, category, metadata_score, coalesce(files, 0) as files, content, availability, composite,
       case when composite >= 80 then 'ok' when composite >= 50 then 'warn' when composite is not null then 'bad' end as level
from scored""")
def dataset_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = R.scorecard(star.datasets(spark, sf_dir), star.audited_files(spark, sf_dir))
    return card.select(
        "dataset_id", "title", "category", "metadata_score", F.coalesce("files", F.lit(0)).alias("files"),
        "content", "availability", "composite", "level",
    ).orderBy(F.asc_nulls_first("composite"), "dataset_id")


@register("delivery_summary", STAR_SQL + f"""
select count(*) as total, count(*) filter (where state = 'ok') as ok,
       count(*) filter (where state = 'roto') as roto,
       count(*) filter (where state = 'no-entrega') as no_entrega,
       count(*) filter (where state = 'omitida') as omitida,
       count(*) filter (where state = 'no-analizado') as no_analizado,
       {pct("count(*) filter (where state = 'roto')", "count(*)")} as broken_pct,
       {pct("count(*) filter (where state = 'no-entrega')", "count(*)")} as not_a_file_pct,
       count(distinct case when state in ('roto','no-entrega') then dataset_id end) as affected_datasets,
       count(distinct dataset_id) as total_datasets
from files""")
def delivery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.delivery_summary(star.audited_files(spark, sf_dir))


@register("delivery_states", STAR_SQL + """
select file_id, status, state, cause,
       case when fetch_status in ('downloaded','truncated') then 'entregado'
            when fetch_status in ('too_large','no_url','error') then 'no-evaluado'
            when fetch_status = 'service' then 'servicio' else 'fallido' end as outcome,
       state in ('omitida','no-analizado') as unevaluated
from files""")
def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.audited_files(spark, sf_dir).select(
        "file_id", "status", "state", "cause", D.fetch_outcome(F.col("fetch_status")).alias("outcome"),
        D.is_unevaluated(F.col("state")).alias("unevaluated"))


@register("delivery_causes", STAR_SQL + f"""
select cause, {case_map('cause', dims.ISSUE_LABELS, dims.DEFAULT_ISSUE_LABEL)} as label, state, count(*) as files
from files where state <> 'ok' group by cause, state""")
def delivery_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.audited_files(spark, sf_dir).filter("state <> 'ok'").groupBy("cause", "state").agg(
        F.count(F.lit(1)).alias("files")
    ).select("cause", D.cause_label(F.col("cause")).alias("label"), "state", "files")


@register("content_summary", STAR_SQL + f"""
select count(case when state = 'ok' then score end) as scored,
       {half_up("avg(case when state = 'ok' then score end)", 1)} as avg_score from files""")
def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.content_summary(star.audited_files(spark, sf_dir))


_GATED = (
    "case when fetch_status in ('downloaded','truncated','service') and naf = 0 and blk = 0 and lim = 0 then score end"
)


@register("report_rollup", STAR_SQL + f""",
g as (select dataset_id, format, grouping_id(dataset_id, format) as gid, count(*) as total,
       count(*) filter (where status = 'ok') as ok,
       count(*) filter (where status not in ('ok','skipped')) as error,
       count(*) filter (where status = 'skipped') as skipped,
       count(*) filter (where fetch_status in ('downloaded','truncated')) as downloaded,
       cast(sum(size_bytes) as bigint) as bytes, avg({_GATED}) as m
  from files group by grouping sets ((dataset_id), (format), ()))
select case gid when 1 then 'dataset' when 2 then 'format' else 'total' end as level, dataset_id, format,
       total, ok, error, skipped, downloaded, bytes,
       case when gid = 1 then floor(m + 0.5) else floor(m * 10.0 + 0.5) / 10.0 end as avg_score,
       {pct('ok', 'total')} as coverage_pct from g""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_rollup(star.audited_files(spark, sf_dir))


@register("dataset_report", STAR_SQL + f""",
g as (select dataset_id, count(*) as files, count(*) filter (where status = 'ok') as analyzed,
       count(*) filter (where status not in ('ok','skipped')) as failed,
       count(*) filter (where status = 'skipped') as skipped, {half_up('avg(' + _GATED + ')')} as score
  from files group by dataset_id)
select *, {pct('analyzed', 'files')} as coverage_pct from g""")
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_dataset(star.audited_files(spark, sf_dir))


@register("format_report", STAR_SQL + f"""
select format, count(*) as total, count(*) filter (where status = 'ok') as ok,
       count(*) filter (where status not in ('ok','skipped')) as error,
       count(*) filter (where status = 'skipped') as skipped,
       count(*) filter (where fetch_status in ('downloaded','truncated')) as downloaded,
       cast(sum(size_bytes) as bigint) as bytes, {half_up('avg(' + _GATED + ')', 1)} as avg_score
from files group by format""")
def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_format(star.audited_files(spark, sf_dir)).orderBy(F.desc("total"), "format")


@register("format_issues", STAR_SQL + """
select format, code, cast(sum(count) as bigint) as cases from iss join files using (file_id) group by format, code""")
def format_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.format_issues(star.issues(spark, sf_dir), star.raw_files(spark, sf_dir)).orderBy(
        "format", F.desc("cases"), "code")


@register("issues_by_code", STAR_SQL + """
select dataset_id, code, cast(sum(count) as bigint) as cases, count(*) as files,
       case min(case severity when 'error' then 0 when 'warning' then 1 else 2 end)
            when 0 then 'error' when 1 then 'warning' else 'info' end as severity
from iss join raw using (file_id) group by dataset_id, code""")
def issues_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issues_by_code(star.issues(spark, sf_dir), star.raw_files(spark, sf_dir))


@register("files_by_issue", f"with {star.ISSUES_SQL.strip()}" + f"""
select code, count(distinct file_id) as files, cast(sum(count) as bigint) as cases,
       case when code in ({quoted(dims.LIMITATION_CODES)}) then 'portal'
            when code in ({quoted(dims.AVAILABILITY_CODES)}) then 'availability'
            when code in ({quoted(dims.FORMAT_CODES)}) then 'format' else 'content' end as category,
       {case_map('code', dims.ISSUE_LABELS, dims.DEFAULT_ISSUE_LABEL)} as label
from iss group by code""")
def files_by_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.files_by_issue(star.issues(spark, sf_dir))


@register("issue_totals", f"with {star.ISSUES_SQL.strip()}" + """
select file_id, cast(coalesce(sum(count) filter (where severity = 'error'), 0) as bigint) as errors,
       cast(coalesce(sum(count) filter (where severity = 'warning'), 0) as bigint) as warnings
from iss group by file_id""")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issue_totals(star.issues(spark, sf_dir))


@register("format_states", STAR_SQL + """,
g as (select dataset_id, format, count(*) filter (where state not in ('omitida','no-analizado')) as evaluated,
       count(*) filter (where state = 'ok') as ok from files group by dataset_id, format)
select *, case when evaluated = 0 then 'sin-datos' when ok = evaluated then 'ok'
               when ok = 0 then 'roto' else 'parcial' end as format_state from g""")
def format_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.format_states(star.audited_files(spark, sf_dir))


@register("format_content_scores", STAR_SQL + f"""
select format, count(case when lim = 0 then score end) as scored,
       {half_up("avg(case when lim = 0 then score end)", 1)} as avg_score from files group by format""")
def format_content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.format_content_scores(star.audited_files(spark, sf_dir))


@register("reuse_consequences", f"with {star.ISSUES_SQL.strip()},\n" + "g as (\n" + " union all\n".join(
    f"  select '{icon}' as icon, '{sev}' as severity, '{title}' as title, count(distinct file_id) as files "
    f"from iss where code in ({quoted(codes)})"
    for codes, icon, sev, title in dims.CONSEQUENCE_GROUPS) + ")\nselect * from g where files > 0")
def reuse_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reuse_consequences(star.audited_files(spark, sf_dir))


ROWS_SQL = STAR_SQL + """,
rows as (
  select file_id, dataset_id, format, url, state, http_status,
         case when state = 'ok' then 'contenido' else 'entrega' end as family,
         case when state = 'ok' then error_codes[1] else cause end as cause_code,
         case when state = 'ok' then error_codes else [cause] end as cause_codes,
         case when state = 'ok' then cast(len(error_codes) as int) end as error_issues
  from files where state <> 'ok' or len(error_codes) > 0),
ft as (select format, count(*) as format_total from files group by format),
sysc as (
  select concat(format, '|', cause_code) as key, format, cause_code, affected, format_total, datasets,
         format_total > 1 and affected = format_total as whole_format
  from (select format, cause_code, count(*) as affected, count(distinct dataset_id) as datasets
        from rows where family = 'entrega' group by format, cause_code) join ft using (format))"""


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.file_issue_rows(star.audited_files(spark, sf_dir))


@register("file_issue_rows", ROWS_SQL + """
select file_id, dataset_id, title, category, format, url, http_status, family, state, cause_code,
       array_to_string(cause_codes, ',') as cause_codes, error_issues
from rows left join ds using (dataset_id)""")
def file_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.file_issue_rows(star.audited_files(spark, sf_dir), star.datasets(spark, sf_dir),
                             star.files_per_dataset(spark, sf_dir))
    return rows.select(
        "file_id", "dataset_id", "title", "category", "format", "url", "http_status", "family", "state",
        "cause_code", F.array_join("cause_codes", ",").alias("cause_codes"), "error_issues")


@register("filtered_file_issues", ROWS_SQL + """
select file_id, format, cause_code from rows left join ds using (dataset_id)
where family = 'contenido' and list_has_any(cause_codes, ['error-tipo', 'fila-vacia'])
  and contains(lower(concat_ws(' ', title, category, format, url)), 'household')""")
def filtered_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.file_issue_rows(star.audited_files(spark, sf_dir), star.datasets(spark, sf_dir),
                             star.files_per_dataset(spark, sf_dir))
    return W.filter_file_issues(rows, family="contenido", causes=["error-tipo", "fila-vacia"],
                                text="Household").select("file_id", "format", "cause_code")


@register("facets", ROWS_SQL + """,
c as (select code as value, count(*) as files from (select unnest(cause_codes) as code from rows) group by code)
select 'family' as facet, family as value, count(*) as files from rows group by family
union all select 'cause', value, files from (select * from c order by files desc, value limit 4)
union select 'cause', value, files from c where value = 'too_large'""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.facets(issue_rows(spark, sf_dir), active=["too_large"], top=4)


@register("systemic_causes", ROWS_SQL + f"""
select *, {case_map('cause_code', dims.ISSUE_LABELS, dims.DEFAULT_ISSUE_LABEL)} as cause_label from sysc""")
def systemic_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = star.audited_files(spark, sf_dir)
    rows = W.file_issue_rows(files).filter("family = 'entrega'")
    return W.systemic_causes(rows, W.format_totals(star.raw_files(spark, sf_dir)))


@register("failures_by_cause", ROWS_SQL + """
select code, count(*) as affected, count(distinct dataset_id) as datasets
from (select dataset_id, unnest(cause_codes) as code from rows) group by code""")
def failures_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.group_by_cause(issue_rows(spark, sf_dir))


@register("failures_by_format", ROWS_SQL + """
select coalesce(nullif(format, ''), 'Sin clasificar') as value, count(*) as affected,
       count(distinct dataset_id) as datasets from rows group by 1""")
def failures_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.group_by_field(issue_rows(spark, sf_dir), "format")


@register("failures_by_category", ROWS_SQL + """
select coalesce(nullif(category, ''), 'Sin clasificar') as value, count(*) as affected,
       count(distinct dataset_id) as datasets from rows left join ds using (dataset_id) group by 1""")
def failures_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.failures_by_category(issue_rows(spark, sf_dir), star.datasets(spark, sf_dir))


ALERTS_SQL = SCORED_SQL + f""",
bc as (select dataset_id, code, cast(sum(count) as bigint) as cases from iss join raw using (file_id)
       group by dataset_id, code),
rel as (select *, code in ({quoted(dims.BLOCKING_CODES)}) as blocking from bc
        where code in ({quoted(dims.BLOCKING_CODES)}) or code in ({quoted(dims.HIGH_IMPACT_CODES)})
           or (code = 'celda-faltante' and cases >= 1000)),
al as (select dataset_id, title, files, content, composite, has_blocking,
              case when has_blocking or content < 50 then 'critical' else 'warning' end as level, causes, n_causes,
              av, fo, co
       from (select dataset_id, bool_or(blocking) as has_blocking, count(*) as n_causes,
                    string_agg(code || ':' || cases, ',' order by blocking desc, cases desc, code) as causes,
                    bool_or(code in ({quoted(dims.AVAILABILITY_CODES)})) as av,
                    bool_or(code in ({quoted(dims.FORMAT_CODES)})) as fo,
                    bool_or(code not in ({quoted((*dims.AVAILABILITY_CODES, *dims.FORMAT_CODES, *dims.LIMITATION_CODES))})) as co
             from rel group by dataset_id) join scored using (dataset_id))"""


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_code = R.issues_by_code(star.issues(spark, sf_dir), star.raw_files(spark, sf_dir))
    scored = R.scorecard(star.datasets(spark, sf_dir), star.audited_files(spark, sf_dir))
    return W.alerts(by_code, scored.select("dataset_id", "title", "files", "content", "composite"))


@register("alerts", ALERTS_SQL + "\nselect dataset_id, title, files, content, composite, level, causes from al")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(spark, sf_dir).select(
        "dataset_id", "title", "files", "content", "composite", "level",
        F.array_join(F.transform("causes", lambda c: F.concat_ws(":", c["code"], c["cases"])), ",").alias("causes"),
    )


@register("worst_alerts", ALERTS_SQL + """
select dataset_id, composite, level from al order by composite asc nulls first, dataset_id limit 500""")
def worst_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.worst_first(alert_table(spark, sf_dir), limit=500).select("dataset_id", "composite", "level")


@register("alert_summary", ALERTS_SQL + """
select count(*) as total, count(*) filter (where level = 'critical') as critical,
       count(*) filter (where level = 'warning') as warning, count(*) filter (where av) as availability,
       count(*) filter (where fo) as format, count(*) filter (where co) as content from al""")
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.alert_summary(alert_table(spark, sf_dir))


@register("level_histogram", SCORED_SQL + """
select case when content is null then 'unscored' when content >= 80 then 'good' when content >= 50 then 'fair'
            else 'poor' end as level, count(*) as datasets from scored group by 1""")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.level_histogram(R.scorecard(star.datasets(spark, sf_dir), star.audited_files(spark, sf_dir)))


@register("publisher_scores", SCORED_SQL + f"""
select n_name as publisher, count(*) as datasets, count(content) as scored, {half_up('avg(content)', 1)} as avg_score
from scored join nation on publisher_id = n_nationkey where contains(lower(n_name), 'nation_1') group by 1""")
def publisher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per publisher whose name contains a text (any case).

    The means are taken per publisher id first; only those few rows meet the names.
    """
    scored = R.scorecard(star.datasets(spark, sf_dir), star.audited_files(spark, sf_dir))
    nation = star.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("publisher_id"), F.col("n_name").alias("publisher"))
    return (
        R.by_publisher(scored, "publisher_id").join(nation, "publisher_id")
        .filter(F.lower("publisher").contains("NATION_1".lower())).drop("publisher_id")
    )


@register("catalog_badge", SCORED_SQL + f""",
b as (select {half_up('avg(composite)')} as score, count(composite) as datasets from scored)
select *, case when score >= 80 then 'ok' when score >= 50 then 'warn' else 'bad' end as level from b""")
def catalog_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.catalog_score(R.scorecard(star.datasets(spark, sf_dir), star.audited_files(spark, sf_dir)))


@register("headline_tones", STAR_SQL + f""",
h as (select {pct("count(*) filter (where state = 'roto')", "count(*)")} as broken_pct,
             {half_up("avg(case when state = 'ok' then score end)", 1)} as avg_score from files)
select broken_pct, avg_score,
       case when broken_pct >= 15 then 'bad' when broken_pct >= 5 then 'warn' else 'ok' end as broken_tone,
       case when avg_score is null then 'warn' when avg_score < 60 then 'bad'
            when avg_score < 80 then 'warn' else 'ok' end as content_tone from h""")
def headline_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.functions import numbers as N
    files = star.audited_files(spark, sf_dir)
    figures = files.agg(
        N.percent(F.count_if(F.col("state") == "roto"), F.count(F.lit(1))).alias("broken_pct"),
        N.round_half_up(F.avg(D.readable_score(F.col("score"), F.col("state"))), 1).alias("avg_score"))
    return figures.select("broken_pct", "avg_score", S.broken_tone(F.col("broken_pct")).alias("broken_tone"),
                          S.mean_tone(F.col("avg_score")).alias("content_tone"))


@register("content_score", f"with {star.CONTENT_ISSUES_SQL.strip()}" + """,
k as (select file_id, count(*) filter (where severity = 'error') as ek,
             count(*) filter (where severity = 'warning') as wk,
             coalesce(sum(count) filter (where severity = 'error'), 0) as ec from found group by file_id)
select file_id, cast(greatest(0, least(100, 100 - least(60, 15 * ek) - 5 * wk
       - case when ec > 1000 then 10 else 0 end)) as int) as content_score, ec = 0 as analysis_ok from k""")
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.operators.issues import score_files
    return score_files(star.content_issues(spark, sf_dir))


@register("issue_impact", f"with {star.ISSUES_SQL.strip()}" + """
select file_id, code, count as cases, count * 1.0::double / max(count) over (partition by file_id) as impact,
       cast(row_number() over (partition by file_id order by
            case severity when 'error' then 0 when 'warning' then 1 else 2 end, count desc, code) as int) as place
from iss""")
def issue_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.operators.issues import impact_share
    return impact_share(star.issues(spark, sf_dir)).select(
        "file_id", "code", F.col("count").alias("cases"), "impact", "place")


@register("file_slugs", STAR_SQL + """,
b as (select file_id, dataset_id, idx, lower(format) as base,
             row_number() over (partition by dataset_id, lower(format) order by idx) as k from files)
select file_id, dataset_id, idx, base || case when k > 1 then '-' || k else '' end as slug from b""")
def file_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.file_slugs(star.files(spark, sf_dir)).select("file_id", "dataset_id", "idx", "slug")


@register("format_volume", STAR_SQL + """
select format, cast(max(p) as bigint) as max_primary, cast(max(s) as bigint) as max_secondary,
       cast(sum(coalesce(r * c, 0)) as bigint) as cells
from (select format, r, c,
        case format when 'JSON' then coalesce(case when file_id % 2 = 0 then size_bytes % 900 end, r)
                    when 'XLSX' then coalesce(r * 3, r) when 'XML' then size_bytes % 700 when 'WMS' then file_id % 17
                    when 'SHP' then size_bytes % 500 else r end as p,
        case format when 'JSON' then c when 'XLSX' then coalesce(case when file_id % 3 = 0 then 2 end, c)
                    when 'XML' then r when 'WMS' then null when 'SHP' then c + 1 else c end as s
      from (select *, size_bytes % 1000 as r, file_id % 12 as c from files)) group by format""")
def format_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume metric of each format, on metric columns derived from size and key."""
    f = star.raw_files(spark, sf_dir).withColumns({
        "r": F.expr("size_bytes % 1000"), "c": F.expr("file_id % 12")})
    metrics = {
        "rows": F.col("r"), "columns": F.col("c"), "elements": F.expr("case when file_id % 2 = 0 then size_bytes % 900 end"),
        "total_rows": F.col("r") * 3, "sheet_count": F.expr("case when file_id % 3 = 0 then cast(2 as bigint) end"),
        "total_elements": F.expr("size_bytes % 700"), "items": F.col("r"), "layers": F.expr("file_id % 17"),
        "features": F.expr("size_bytes % 500"), "fields": F.col("c") + 1,
    }
    primary, secondary = R.volume(F.col("format"), metrics)
    return f.groupBy("format").agg(
        F.max(primary).alias("max_primary"), F.max(secondary).alias("max_secondary"),
        F.sum(R.analyzed_cells(F.col("r"), F.col("c"))).alias("cells"))


@register("dataset_lite", STAR_SQL + f""",
t as (select file_id, coalesce(sum(count) filter (where severity = 'error'), 0) as errors,
             coalesce(sum(count) filter (where severity = 'warning'), 0) as warnings from iss group by file_id),
g as (select dataset_id, count(*) as files, count(*) filter (where status = 'ok') as analyzed,
             count(*) filter (where status not in ('ok','skipped')) as failed,
             max(size_bytes % 1000) as max_rows, max(file_id % 12) as max_cols,
             cast(coalesce(sum(errors), 0) as bigint) as error_issues,
             cast(coalesce(sum(warnings), 0) as bigint) as warning_issues,
             {half_up("avg(case when state = 'ok' then score end)")} as score,
             {pct("count(*) filter (where state = 'ok')", "count(*) filter (where state not in ('omitida','no-analizado'))", "null")} as availability_pct
      from files left join t using (file_id) group by dataset_id)
select *, case when analyzed = files then 'ok' when failed = files then 'error' else 'parcial' end as analysis_state from g""")
def dataset_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = star.audited_files(spark, sf_dir).withColumns({
        "rows": F.expr("size_bytes % 1000"), "cols": F.expr("file_id % 12")})
    return R.dataset_lite(files, star.issues(spark, sf_dir))


@register("size_labels", STAR_SQL + """
select file_id, case when b = 0 then '0 B'
    when b >= 1000000000 then translate(format('{:,.2f}', floor(b / 10000000.0::double + 0.5) / 100), ',.', '.,') || ' GB'
    when b >= 1000000 then replace(format('{:.1f}', floor(b / 100000.0::double + 0.5) / 10), '.', ',') || ' MB'
    when b >= 1000 then cast(cast(floor(b / 1000.0::double + 0.5) as bigint) as varchar) || ' KB'
    else cast(b as varchar) || ' B' end as size_label,
  case when ms < 60000 then replace(format('{:.1f}', floor(ms / 100.0::double + 0.5) / 10), '.', ',') || 's'
    else cast(ms // 60000 as varchar) || 'm ' || cast(cast(floor((ms / 1000.0::double) % 60 + 0.5) as bigint) as varchar) || 's' end as duration_label
from (select file_id, size_bytes * (file_id % 3) * 97 as b, size_bytes % 200000 as ms from raw)""")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish wording of sizes and durations."""
    f = star.raw_files(spark, sf_dir)
    return f.select("file_id", size_text(F.expr("size_bytes * (file_id % 3) * 97")).alias("size_label"),
                    duration_text(F.expr("size_bytes % 200000")).alias("duration_label"))


@register("note_dictionary", STAR_SQL + """,
n as (select file_id, 'HTTP ' || coalesce(cast(http_status as varchar), '?') || ' ' || fetch_status as note from raw),
d as (select note, row_number() over (order by min(file_id)) - 1 as note_id from n group by note)
select file_id, note_id from n join d using (note)""")
def note_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = star.raw_files(spark, sf_dir).withColumn(
        "note", F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("?")),
                         F.lit(" "), "fetch_status"))
    coded, _notes = W.dictionary_encode(noted, "note", "file_id")
    return coded.select("file_id", "note_id")


@register("fetch_issues", f"""
with r as (select o_orderkey as file_id, {star.FETCH_EXPR} as fs from orders)
select file_id, case when fs in ('no_url','too_large') then 'skipped' when fs in ('http_error','unreachable') then 'error' end as fetch_decides,
       case when fs in ('http_error','unreachable') then 'descarga' end as issue_code,
       case when fs in ('http_error','unreachable') then 'error' end as issue_severity from r""")
def fetch_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.issues_from_fetch(star.raw_files(spark, sf_dir)).select(
        "file_id", "fetch_decides", "issue_code", "issue_severity")


@register("unknown_statuses", f"""
select file_id, fetch_status from (select o_orderkey as file_id, case when o_orderstatus = 'P' then 'lost' else {star.FETCH_EXPR} end as fetch_status from orders)
where fetch_status = 'lost'""")
def unknown_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.when(F.col("o_orderstatus") == "P", "lost").otherwise(F.expr(star.FETCH_EXPR)).alias("fetch_status"))
    return FO.unknown_statuses(log)


@register("broken_datasets", STAR_SQL + """
select dataset_id, count(*) as failing from files where state in ('roto','no-entrega') group by dataset_id""")
def broken_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.broken_datasets(star.audited_files(spark, sf_dir))


@register("issue_maps", STAR_SQL + """,
b as (select dataset_id, code, sum(count) as n, min(case severity when 'error' then 0 when 'warning' then 1 else 2 end) as s
      from iss join raw using (file_id) group by 1, 2)
select dataset_id, string_agg(code || '=' || cast(n as bigint), ',' order by code) as cases,
       string_agg(code || '=' || (['error','warning','info'])[s + 1], ',' order by code) as severities from b group by dataset_id""")
def issue_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = R.issue_maps(R.issues_by_code(star.issues(spark, sf_dir), star.raw_files(spark, sf_dir)))

    def text(column: str):
        pairs = F.array_sort(F.map_entries(column))
        return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")

    return maps.select("dataset_id", text("issues_by_code").alias("cases"), text("issue_severity").alias("severities"))


@register("resolved_files", STAR_SQL + """,
b as (select file_id, dataset_id, lower(format) as base, row_number() over (partition by dataset_id, lower(format) order by idx) as k from raw)
select file_id, dataset_id from b where base = 'csv' and k = 2""")
def resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file a slug stands for, in every dataset that has it."""
    return W.file_slugs(star.files(spark, sf_dir)).filter(F.col("slug") == "csv-2").select("file_id", "dataset_id")


@register("cause_search", ROWS_SQL + """
select file_id from rows where list_has_any(cause_codes, ['descarga', 'encabezado-vacio'])""")
def cause_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-of match on the main cause or any other code of a row."""
    wanted = D.matches_causes(F.col("cause_code"), F.col("cause_codes"), ["descarga", "encabezado-vacio"])
    return issue_rows(spark, sf_dir).filter(wanted).select("file_id")
