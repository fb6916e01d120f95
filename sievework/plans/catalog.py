"""Catalogue queries: metadata, filters, pages, run comparison, sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import text as T
from sievework.operators import catalog as CO
from sievework.operators import files as FO
from sievework.operators import rollup as R
from sievework.operators import runs as RU
from sievework.operators import sampling as SA
from sievework.operators import work as W
from sievework.plans import star
from sievework.plans.report import ROWS_SQL, case_map, half_up, pct, quoted
from sievework.plans.star import STAR_SQL, table
from sievework.session import checkpoint_dir, written_table
from sievework.sources import catalog_xml

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2002-06-01 00:00:00"
PREFIX = dims.THEME_PREFIX


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- catalogue rows derived from customer and orders, same text both sides ---
FIELDS = {
    "dataset_id": "concat('https://datos.example/set/', cast(c_custkey as {s}))",
    "title": "case when c_custkey % 40 = 0 then '' else concat(case c_custkey % 4 when 0 then 'Ávila ' "
             "when 1 then 'Ñandú ' when 2 then 'nube ' else 'Ojo ' end, c_name) end",
    "description": "case when c_custkey % 6 = 0 then '' else concat('Datos de ', lower(c_mktsegment)) end",
    "license_uri": "case c_custkey % 6 when 0 then 'https://creativecommons.org/licenses/by/4.0/deed.es' "
                   "when 1 then 'http://creativecommons.org/licenses/BY-SA/4.0' when 2 then 'http://lic.example/IGCYL' "
                   "when 3 then '' when 4 then 'http://opendatacommons.org/licenses/odbl/' else 'otra' end",
    "publisher": "case when c_custkey % 11 = 0 then '' else concat('http://org.example/NATION_', cast(c_nationkey as {s})) end",
    "language": "case when c_custkey % 13 = 0 then '' else 'es' end",
    "spatial": "case when c_custkey % 8 = 0 then '' else 'http://org.example/territorio/Valladolid' end",
    "identifier": "case when c_custkey % 10 = 0 then '' else cast(c_custkey as {s}) end",
    "contact_point": "case when c_custkey % 2 = 0 then '' else 'presente' end",
    "periodicity": "case c_custkey % 4 when 0 then cast(1 as double) when 1 then cast(3 as double) when 2 then cast(12 as double) end",
}
THEMES = (
    f"case c_custkey % 5 when 0 then {{e}} when 1 then {{o}}'{PREFIX}medio-ambiente'{{c}} "
    f"when 2 then {{o}}'{PREFIX}vivienda', '{PREFIX}salud'{{c}} when 3 then {{o}}'{PREFIX}vivienda'{{c}} "
    f"else {{o}}'{PREFIX}turismo'{{c}} end"
)
KEYWORDS = "case when c_custkey % 7 = 0 then {e} else {o}lower(c_mktsegment), 'mercado'{c} end"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows.  Formats per dataset are bounded by the format vocabulary."""
    arrays = {"e": "cast(array() as array<string>)", "o": "array(", "c": ")"}
    base = table(spark, sf_dir, "customer").select(
        "c_custkey", *[F.expr(v.format(s="string")).alias(k) for k, v in FIELDS.items()],
        F.expr(THEMES.format(**arrays)).alias("themes"), F.expr(KEYWORDS.format(**arrays)).alias("keywords"))
    per_format = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", F.expr(star.FORMAT_EXPR).alias("format")
    ).groupBy("o_custkey", "format").agg(
        F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n"),
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    dated = per_format.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "format"))), lambda s: s["format"]).alias("formats"),
        F.sum("n").alias("files"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    day = "yyyy-MM-dd"
    return base.join(dated, "c_custkey", "left").select(
        "c_custkey", *FIELDS, "themes", "keywords",
        F.coalesce("formats", F.array().cast("array<string>")).alias("formats"),
        F.coalesce("files", F.lit(0).cast("bigint")).alias("files"),
        F.coalesce(F.date_format("lo", day), F.lit("")).alias("issued"),
        F.when(F.col("c_custkey") % 3 != 0, F.coalesce(F.date_format("hi", day), F.lit(""))).otherwise("").alias("modified"),
        T.license_label(F.col("license_uri")).alias("license"), T.category_of(F.col("themes")).alias("category"))


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.diagnose(catalog(spark, sf_dir), F.lit(NOW).cast("timestamp"))


_LISTS = {"e": "cast([] as varchar[])", "o": "[", "c": "]"}
_GAP = {
    "sin-titulo": "title = ''", "sin-descripcion": "description = ''",
    "sin-licencia-identificada": "license = 'Otro'", "sin-organismo": "publisher = ''",
    "sin-fecha-publicacion": "issued = ''", "sin-idioma": "language = ''", "sin-cobertura": "spatial = ''",
    "sin-tematica": "len(themes) = 0", "sin-palabras-clave": "len(keywords) = 0",
    "sin-fecha-actualizacion": "modified = ''", "sin-periodicidad": "periodicity is null",
    "licencia-restrictiva": "license = 'IGCYL-NC'",
    "sin-formato-abierto": "len(formats) > 0 and not list_has_any(formats, ['CSV','JSON','GeoJSON'])",
    "sin-identificador": "identifier = ''", "sin-punto-contacto": "contact_point = ''",
}
_OPEN = "case {f} " + " ".join(f"when '{k}' then {v}" for k, v in dims.FORMAT_OPENNESS.items()) + " else 40 end"
CATALOG_SQL = f"""
pf as (select o_custkey, {star.FORMAT_EXPR} as format, min(o_orderkey) as first, count(*) as n,
              min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by 1, 2),
dt as (select o_custkey, list(format order by first) as formats, cast(sum(n) as bigint) as files,
              min(lo) as lo, max(hi) as hi,
              max({_OPEN.format(f='format')}) as best from pf group by 1),
c0 as (select c_custkey, {', '.join(v.format(s='varchar') + ' as ' + k for k, v in FIELDS.items())},
              {THEMES.format(**_LISTS)} as themes, {KEYWORDS.format(**_LISTS)} as keywords,
              coalesce(formats, []) as formats, coalesce(files, 0) as files, best,
              coalesce(strftime(lo, '%Y-%m-%d'), '') as issued,
              case when c_custkey % 3 <> 0 then coalesce(strftime(hi, '%Y-%m-%d'), '') else '' end as modified
       from customer left join dt on c_custkey = o_custkey),
cat as (select *, case when license_uri = '' then 'Otro'
    when regexp_matches(license_uri, 'creativecommons\\.org/licenses/by-sa/4\\.0', 'i') then 'CC-BY-SA-4.0'
    when regexp_matches(license_uri, 'creativecommons\\.org/licenses/by/4\\.0', 'i') then 'CC-BY-4.0'
    when regexp_matches(license_uri, 'opendatacommons\\.org/licenses/odbl', 'i') then 'ODbL'
    when regexp_matches(license_uri, 'igcyl', 'i') then 'IGCYL-NC' else 'Otro' end as license,
    case c_custkey % 5 when 1 then 'Medio Ambiente' when 2 then 'Salud' when 4 then 'Cultura' else 'Otros' end as category,
    case when modified <> '' then modified when issued <> '' then issued end as ref from c0),
gaps as (select *, list_filter([{', '.join(f"case when {t} then '{g}' end" for g, t in _GAP.items())}],
                 lambda x: x is not null) as gaps,
         (epoch_ms(timestamp '{NOW}') - epoch_ms(cast(ref as timestamp))) / 2630016000.0::double as months from cat),
fresh as (select *, months / periodicity as ratio,
         case when periodicity is not null then greatest(0.0, floor(months / periodicity * 10 + 0.5) / 10) end as periods_late,
         (9 - len(list_filter(gaps, lambda x: x in ({quoted(dims.COMPLETENESS_GAPS)})))) / 9.0::double as completeness
         from gaps),
diag as (select *, case when ref is null then 'sin-fecha' when periodicity is null then 'sin-periodicidad'
           when periods_late <= 1 then 'al-dia' when modified = '' then 'no-verificable' else 'vencido' end as freshness,
         case when modified <> '' then 'modified' when issued <> '' then 'issued' else 'none' end as reference,
         cast(floor(completeness * 100 * 0.4::double
           + (case when len(formats) = 0 then 0.0::double else best * 0.8::double + least(len(formats), 3) / 3.0::double * 100 * 0.2::double end) * 0.25::double
           + (case when ref is null then 40 when periodicity is null then 80 when ratio <= 1 then 100
                   when ratio <= 2 then 75 when ratio <= 4 then 50 else 25 end) * 0.25::double
           + (case license when 'CC-BY-4.0' then 100 when 'IGCYL-NC' then 55 else 60 end) * 0.1::double + 0.5) as bigint) as metadata_score
         from fresh)"""
CAT = "with " + CATALOG_SQL.strip()


@register("metadata_score", CAT + """
select dataset_id, license, category, metadata_score, completeness,
  case when metadata_score >= 80 then 'healthy' when metadata_score >= 50 then 'warning' else 'critical' end as status
from diag""")
def metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select(
        "dataset_id", "license", "category", "metadata_score", "completeness", "status")


@register("metadata_gaps", CAT + "\nselect dataset_id, array_to_string(gaps, ',') as gaps from diag")
def metadata_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("dataset_id", F.array_join("gaps", ",").alias("gaps"))


@register("freshness", CAT + "\nselect dataset_id, freshness, periods_late, reference from diag")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select("dataset_id", "freshness", "periods_late", "reference")


@register("gap_groups", CAT + f"""
select code, {case_map('code', {k: v[0] for k, v in dims.METADATA_GAPS.items()})} as label,
       {case_map('code', {k: v[1] for k, v in dims.METADATA_GAPS.items()})} as field,
       {case_map('code', {k: v[2] for k, v in dims.METADATA_GAPS.items()})} as axis, count(*) as datasets
from (select unnest(gaps) as code from diag) group by code""")
def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.gap_groups(diagnosed(spark, sf_dir))


@register("gap_members", CAT + """
select g.code, dataset_id, title, periods_late,
  case periodicity when 1 then 'mensual' when 3 then 'trimestral' when 12 then 'anual' end as periodicity_label
from diag, unnest(gaps) as g(code)""")
def gap_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.gap_members(diagnosed(spark, sf_dir))


@register("overdue", CAT + "\nselect dataset_id, title, periods_late from diag where freshness = 'vencido'")
def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.overdue(diagnosed(spark, sf_dir)).select("dataset_id", "title", "periods_late")


@register("datasets_with_gaps", CAT + """
select count(*) filter (where len(list_filter(gaps, lambda x: x not in ('sin-identificador','sin-punto-contacto'))) > 0) as with_gaps,
       count(*) as datasets from diag""")
def datasets_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.datasets_with_gaps(diagnosed(spark, sf_dir))


@register("catalog_stats", CAT + """
select 'category' as facet, category as value, count(*) as n from diag group by 2
union all select 'license', license, count(*) from diag group by 2
union all select 'status', case when metadata_score >= 80 then 'healthy' when metadata_score >= 50 then 'warning' else 'critical' end, count(*) from diag group by 2
union all select 'format', f, count(*) from (select unnest(formats) as f from diag) group by 2""")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.catalog_stats(diagnosed(spark, sf_dir))


@register("catalog_totals", CAT + f"""
select count(*) as datasets, cast(sum(files) as bigint) as files, {half_up('avg(metadata_score)', 1)} as avg_score,
       min(nullif(issued, '')) as first_day, max(nullif(issued, '')) as last_day from diag""")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.catalog_totals(diagnosed(spark, sf_dir))


LITE_SQL = STAR_SQL + "," + CATALOG_SQL.strip() + f""",
lt as (select dataset_id as k, {half_up("avg(case when state = 'ok' then score end)")} as score,
         {pct("count(*) filter (where state = 'ok')", "count(*) filter (where state not in ('omitida','no-analizado'))", "null")} as availability_pct,
         case when count(*) filter (where status = 'ok') = count(*) then 'ok'
              when count(*) filter (where status not in ('ok','skipped')) = count(*) then 'error' else 'parcial' end as analysis_state
       from files group by dataset_id),
shown as (select diag.*, score, availability_pct, analysis_state,
  case when availability_pct is null then metadata_score
       else least(cast(floor(cast(metadata_score as double) * 0.4::double + availability_pct * 0.3::double
            + coalesce(score, 0) * 0.3::double + 0.5) as bigint), case when availability_pct < 80 then 79 else 1000 end) end as composite
  from diag left join lt on c_custkey = k)"""


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue joined to the report by dataset slug."""
    lite = R.dataset_lite(
        star.audited_files(spark, sf_dir).withColumns({"rows": F.lit(None), "cols": F.lit(None)}),
        star.issues(spark, sf_dir),
    ).select(F.col("dataset_id").cast("string").alias("slug"), "score", "availability_pct", "analysis_state")
    cat = diagnosed(spark, sf_dir).withColumn("slug", T.dataset_slug(F.col("dataset_id")))
    from sievework.functions.scores import composite_score
    return cat.join(lite, "slug", "left").withColumn("composite", composite_score(
        F.col("metadata_score"), F.col("availability_pct"), F.col("score")))


@register("catalog_scores", LITE_SQL + """
select dataset_id, metadata_score, availability_pct, score, composite, coalesce(analysis_state, 'sin-datos') as analysis_state from shown""")
def catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.sort_catalog(shown(spark, sf_dir), "quality-desc").select(
        "dataset_id", "metadata_score", "availability_pct", "score", "composite",
        F.coalesce("analysis_state", F.lit("sin-datos")).alias("analysis_state"))


@register("catalog_filtered", LITE_SQL + """
select dataset_id, title, analysis_state from shown
where list_has_any(formats, ['SHP','KML','GML','WMS','WFS','GeoJSON','ECW']) and category in ('Salud', 'Otros')
  and list_has_any(formats, ['CSV','XML']) and license in ('Otro', 'ODbL') and substr(issued, 1, 10) >= '1992-02-01'
  and substr(issued, 1, 10) <= '1998-01-01' and analysis_state = 'parcial'
  and contains(strip_accents(lower(concat_ws(' ', title, description, publisher, array_to_string(keywords, ' ')))), 'customer')
  and contains(strip_accents(lower(concat_ws(' ', title, description, publisher, array_to_string(keywords, ' ')))), 'nandu')""")
def catalog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = CO.CatalogFilters.parse({
        "geo": "1", "categorias": "Salud,Otros", "formatos": "CSV, XML", "licencias": "Otro,ODbL",
        "desde": "1992-02-01", "hasta": "1998-01-01", "analisis": "parcial", "q": "  ÑANDÚ   customer "})
    return CO.filter_catalog(shown(spark, sf_dir), wanted).select("dataset_id", "title", "analysis_state")


@register("catalog_page", LITE_SQL + """,
hits as (select * from shown where contains(strip_accents(lower(concat_ws(' ', title, description, publisher, array_to_string(keywords, ' ')))), 'avila')
         and coalesce(analysis_state, 'sin-datos') <> 'sin-datos' and analysis_state = 'parcial')
select dataset_id, title, composite, issued, modified from hits
order by coalesce(nullif(modified, ''), issued) desc, dataset_id limit 12 offset 12""")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = CO.CatalogFilters.parse({"q": "ávila", "analisis": "parcial", "limit": "12", "page": "2"})
    rows, _numbers = CO.catalog_page(shown(spark, sf_dir), wanted)
    return rows.select("dataset_id", "title", "composite", "issued", "modified")


@register("catalog_labels", CAT + """
select dataset_id, regexp_extract(dataset_id, '([0-9]+)$', 1) as slug,
  case c_custkey % 5 when 0 then null when 1 then 'Medio ambiente' when 2 then 'Vivienda' when 3 then 'Vivienda' else 'Turismo' end as theme,
  case when spatial = '' then null else 'Valladolid' end as territory,
  case when ref is null then null else cast(day(cast(ref as date)) as varchar) || ' de ' ||
    (['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'])[month(cast(ref as date))]
    || ' de ' || cast(year(cast(ref as date)) as varchar) end as day_text,
  case when ref is null then 'Fecha desconocida' else case when modified <> '' then 'Actualizado hace ' else 'Publicado hace ' end ||
    case when d < 30 then d || ' día' || case when d = 1 then '' else 's' end
         when d // 30 < 12 then (d // 30) || ' mes' || case when d // 30 = 1 then '' else 'es' end
         else (d // 360) || ' año' || case when d // 360 = 1 then '' else 's' end end end as updated_ago
from (select *, date_diff('day', cast(ref as date), date '2002-06-01') as d from diag)""")
def catalog_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosed(spark, sf_dir).select(
        "dataset_id", T.dataset_slug(F.col("dataset_id")).alias("slug"),
        T.theme_label(F.get("themes", F.lit(0))).alias("theme"), T.spatial_label(F.col("spatial")).alias("territory"),
        T.long_date(F.coalesce(F.when(F.col("modified") != "", F.col("modified")),
                               F.when(F.col("issued") != "", F.col("issued"))).cast("date")).alias("day_text"),
        "updated_ago")


@register("repair_actions", ROWS_SQL + "," + CATALOG_SQL.strip() + f""",
gg as (select code, count(*) as n from (select unnest(gaps) as code from diag) group by code),
ac as (
  select 'entrega:' || key as key, 'entrega' as family,
         {case_map('cause_code', dims.ISSUE_LABELS, dims.DEFAULT_ISSUE_LABEL)} || ' · ' || format as title,
         {case_map('cause_code', dims.DELIVERY_ACTIONS, dims.DEFAULT_DELIVERY_ACTION)} as action, affected,
         'archivos' as unit, datasets, format_total as scope_total, format, whole_format from sysc
  union all
  select 'contenido:' || code, 'contenido', {case_map('code', dims.ISSUE_LABELS)}, {case_map('code', dims.CONTENT_ACTIONS)},
         count(distinct file_id), 'archivos', null, null, null, false from iss
  where code in ({quoted(dims.CONTENT_ACTIONS)}) and code not in ({quoted(dims.BLOCKING_CODES)}) group by code
  union all
  select 'metadatos:' || code, 'metadatos', {case_map('code', {k: f"{v[0]} ({v[1]})" for k, v in dims.METADATA_GAPS.items()})},
         {case_map('code', {k: v[3] for k, v in dims.METADATA_GAPS.items()})}, n, 'conjuntos de datos', null, null, null, false
  from gg where code not in ('sin-identificador', 'sin-punto-contacto'))
select * from ac""")
def repair_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = star.audited_files(spark, sf_dir)
    rows = W.file_issue_rows(files).filter("family = 'entrega'")
    causes = W.systemic_causes(rows, W.format_totals(star.raw_files(spark, sf_dir)))
    gaps = CO.gap_groups(diagnosed(spark, sf_dir))
    return W.repair_actions(
        W.delivery_actions(causes), W.content_actions(R.files_by_issue(star.issues(spark, sf_dir))),
        W.metadata_actions(gaps))


# --- two runs ----------------------------------------------------------------
PREV_SQL = STAR_SQL + """,
cur as (select raw.*, 'T' || title as title, category from raw join ds using (dataset_id)),
prev as (select file_id, dataset_id, url, idx, case when dataset_id % 5 = 0 then 'TXT' else format end as format,
                title, size_bytes from cur where fetch_status <> 'unreachable' and category <> 'MACHINERY'),
prevn as (select *, cast(row_number() over (partition by dataset_id order by idx) - 1 as int) as pidx from prev)"""


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """This run's files and an earlier run: unreachable files and one segment
    were not there yet, and some datasets had another format."""
    from sievework.operators.groups import join_by_key, number_within

    ds = star.datasets(spark, sf_dir).select("dataset_id", F.concat(F.lit("T"), "title").alias("title"), "category")
    current = join_by_key(star.files(spark, sf_dir), ds, ["dataset_id"], "file_id", "inner",
                          star.files_per_dataset(spark, sf_dir))
    previous = current.filter("fetch_status <> 'unreachable' and category <> 'MACHINERY'").withColumn(
        "format", F.when(F.col("dataset_id") % 5 == 0, "TXT").otherwise(F.col("format")))
    renumbered = number_within(previous, ["dataset_id"], "idx", "pidx").withColumn(
        "pidx", (F.col("pidx") - 1).cast("int"))
    return current, renumbered


@register("match_files", PREV_SQL + """,
a as (select *, row_number() over (partition by dataset_id, url order by idx) as k from cur),
b as (select file_id as result_id, dataset_id, url, pidx, row_number() over (partition by dataset_id, url order by pidx) as k from prevn),
m1 as (select a.dataset_id, a.idx, a.url, b.result_id as by_url from a left join b on a.dataset_id = b.dataset_id and a.url = b.url and a.k = b.k),
sp as (select * from b where result_id not in (select by_url from m1 where by_url is not null))
select m1.dataset_id, m1.idx, m1.url, coalesce(by_url, sp.result_id) as result_id,
       case when by_url is not null then 'url' when sp.result_id is not null then 'position' end as matched_by
from m1 left join sp on m1.dataset_id = sp.dataset_id and m1.idx = sp.pidx""")
def match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = two_runs(spark, sf_dir)
    results = previous.select("dataset_id", F.col("pidx").alias("idx"), "url", F.col("file_id").alias("result_id"))
    return RU.match_files(current, results)


PLAN_SQL = PREV_SQL + """,
c1 as (select dataset_id, url, arg_max(format || '|' || title, idx) as m from cur group by 1, 2),
p1 as (select dataset_id, url, arg_max(format || '|' || title, idx) as m from prev group by 1, 2),
j as (select coalesce(c1.dataset_id, p1.dataset_id) as dataset_id, c1.m as cm, p1.m as pm
      from c1 full join p1 on c1.dataset_id = p1.dataset_id and c1.url = p1.url),
pl as (select dataset_id, count(cm) as urls, count(pm) as previous_urls,
              count(*) filter (where cm is distinct from pm) as differences from j group by dataset_id),
plan as (select *, case when previous_urls = 0 then 'new' when urls = 0 then 'removed'
                        when differences > 0 then 'changed' else 'same' end as plan from pl)"""


@register("incremental_plan", PLAN_SQL + "\nselect * from plan")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = two_runs(spark, sf_dir)
    return RU.incremental_plan(current, previous)


@register("forced_urls", PLAN_SQL + """
select distinct dataset_id, url from cur join plan using (dataset_id) where plan in ('new', 'changed')""")
def forced_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = two_runs(spark, sf_dir)
    return RU.forced_urls(current, RU.incremental_plan(current, previous))


@register("resume_backlog", PREV_SQL + """
select file_id, dataset_id, url from cur where not exists (
  select 1 from prev where prev.dataset_id = cur.dataset_id and prev.url = cur.url and prev.size_bytes >= 100000)""")
def resume_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a result; small earlier results are forced to be redone."""
    current, previous = two_runs(spark, sf_dir)
    good = previous.filter("size_bytes >= 100000")
    small = previous.filter("size_bytes < 100000").join(
        good.select("dataset_id", "url").distinct(), ["dataset_id", "url"], "left_anti")
    return RU.resume_backlog(current, previous, small).select("file_id", "dataset_id", "url")


@register("last_results", PREV_SQL + """
select url, arg_max(file_id, file_id) as file_id, arg_max(format, file_id) as format from prev group by url""")
def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    _current, previous = two_runs(spark, sf_dir)
    rows = previous.select("url", "file_id", "format", F.col("file_id").alias("ord"))
    return RU.last_results(rows, ["url"], "ord").select("url", "file_id", "format")


@register("new_datasets", PREV_SQL + """
select dataset_id from ds where dataset_id not in (select dataset_id from prev)""")
def new_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _current, previous = two_runs(spark, sf_dir)
    return CO.new_since(star.datasets(spark, sf_dir), previous).select("dataset_id")


@register("reseed_backlog", STAR_SQL + """,
sh as (select url from raw group by url having count(*) > 1),
m as (select files.*, case when list_has_any(codes, ['celda-faltante']) then 'code' when sh.url is not null then 'shared' end as reseed
      from files left join sh using (url))
select format, count(*) as files, count(*) filter (where reseed = 'shared') as shared, cast(sum(size_bytes) as bigint) as bytes
from m where reseed is not null group by format""")
def reseed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.reseed_backlog(RU.reseed_plan(star.audited_files(spark, sf_dir), ["celda-faltante"]))


@register("report_differences", PREV_SQL + """,
p2 as (select file_id, format, size_bytes from prev), c2 as (select file_id, format, size_bytes from cur)
select coalesce(p2.file_id, c2.file_id) as file_id, case when c2.file_id is null then 'missing'
       when p2.file_id is null then 'surplus' else 'changed' end as difference
from p2 full join c2 on p2.file_id = c2.file_id
where p2.file_id is null or c2.file_id is null or p2.format <> c2.format or p2.size_bytes <> c2.size_bytes""")
def report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = two_runs(spark, sf_dir)
    return RU.report_differences(previous, current, "file_id", ["format", "size_bytes"])


@register("refresh_guard", PREV_SQL + """,
n as (select (select count(*) from (select distinct dataset_id from prev)) as new_rows, (select count(*) from ds) as previous_rows),
r as (select *, case when new_rows < 500 then 'too-few' when new_rows < previous_rows * 0.5 then 'shrunk' end as reason from n)
select *, reason is null as accepted from r""")
def refresh_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _current, previous = two_runs(spark, sf_dir)
    return CO.accept_refresh(previous.select("dataset_id").distinct(), star.datasets(spark, sf_dir))


# --- sampling and verification ----------------------------------------------
BROKEN_SQL = STAR_SQL + """,
broken as (select file_id, cause, format, http_status, size_bytes from files where state = 'roto'),
cc as (select cause, count(*) as n, sum(count(*)) over () as total from broken group by cause),
pl as (select *, greatest(1, floor(n / greatest(2, floor(n * 1.0::double / total * 300 + 0.5)))) as step from cc),
al as (select *, ceil(n / step) as picks,
         coalesce(sum(ceil(n / step)) over (order by n desc, cause rows between unbounded preceding and 1 preceding), 0) as before_n from pl),
rk as (select broken.*, row_number() over (partition by cause order by file_id) - 1 as pos from broken),
samp as (select rk.* from rk join al using (cause)
         where pos % step = 0 and floor(pos / step) < least(picks, 600 - before_n))"""


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.audited_files(spark, sf_dir).filter("state = 'roto'")


@register("stratified_sample", BROKEN_SQL + "\nselect file_id, cause from samp")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.stratified_sample(broken_files(spark, sf_dir), 300).select("file_id", "cause")


@register("broken_census", BROKEN_SQL + """
select cause, count(*) as broken, string_agg(distinct format, ' ' order by format) as formats,
       coalesce(string_agg(distinct cast(http_status as varchar), '/' order by cast(http_status as varchar)), '') as http_statuses
from broken group by cause""")
def broken_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = SA.broken_census(broken_files(spark, sf_dir))
    return census.select("cause", "broken", F.array_join("formats", " ").alias("formats"),
                         F.array_join(F.transform("http_statuses", lambda h: h.cast("string")), "/").alias("http_statuses"))


@register("verification_summary", BROKEN_SQL + """,
v as (select cause, case when http_status is null or http_status >= 400 then 'confirmado'
        when file_id % 3 = 0 then 'confirmado' when cause in ('descarga', 'archivo-vacio') then 'discrepa'
        when size_bytes * 200 > 33554432 then 'inconcluso'
        when cause = 'json-invalido' then case when file_id % 2 = 0 then 'discrepa' else 'confirmado' end
        else 'inconcluso' end as verdict from samp),
r as (select cause, count(*) as checked, count(*) filter (where verdict = 'confirmado') as confirmado,
        count(*) filter (where verdict = 'discrepa') as discrepa, count(*) filter (where verdict = 'inconcluso') as inconcluso
      from v group by cause)
select cause, n as broken, coalesce(checked, 0) as checked, coalesce(confirmado, 0) as confirmado,
       coalesce(discrepa, 0) as discrepa, coalesce(inconcluso, 0) as inconcluso from cc left join r using (cause)""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the sample, from re-check columns derived from the keys."""
    broken = broken_files(spark, sf_dir)
    sample = SA.stratified_sample(broken, 300)
    body = F.when(F.col("file_id") % 3 == 0, "  <!DOCTYPE html><html></html>").otherwise("{}").cast("binary")
    checked = sample.withColumn("verdict", SA.verdict(
        F.col("cause"), F.col("format"), F.col("http_status"), F.col("size_bytes") * 200, body,
        F.col("file_id") % 2 == 0, F.lit(True), F.lit(None).cast("int")))
    return SA.verification_summary(broken, checked)


@register("sibling_services", STAR_SQL + """
select file_id, cast(count(*) filter (where format in ('WMS','WFS')) over (partition by dataset_id)
       - case when format in ('WMS','WFS') then 1 else 0 end as bigint) as sibling_services from raw""")
def sibling_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.sibling_services(star.raw_files(spark, sf_dir)).select("file_id", "sibling_services")


@register("selected_files", STAR_SQL + """
select file_id, format from raw where upper(format) in ('CSV', 'SHP') order by file_id limit 100""")
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.select_files(star.raw_files(spark, sf_dir), ["csv", "Shp"], 100).select("file_id", "format")


@register("url_names", STAR_SQL + """
select file_id, substr(sha1(url), 1, 16) as id, 'f' || (file_id % 6) as basename, '.bin' as extension from raw""")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.raw_files(spark, sf_dir).select(
        "file_id", T.file_key(F.col("url")).alias("id"), T.url_basename(F.col("url")).alias("basename"),
        T.url_extension(F.col("url")).alias("extension"))


# --- a catalogue document written by Spark and read back ---------------------
RDF = (
    "concat('<dcat:dataset><dcat:Dataset rdf:about=\"http://datos.example/set/', cast(o_orderkey as string), '\">"
    "<dct:title xml:lang=\"es\"> Conjunto &amp; ', cast(o_orderkey as string), '</dct:title>"
    "<dct:description>texto <b>con</b> <ol> ', o_orderpriority, '</dct:description>"
    "<dcat:theme rdf:resource=\"" + PREFIX + "salud\"/><dcat:keyword>uno</dcat:keyword><dcat:keyword>dos</dcat:keyword>"
    "<dct:license rdf:resource=\"http://creativecommons.org/licenses/by/4.0/\"/>"
    "<dct:issued rdf:datatype=\"d\">', date_format(o_orderdate, 'yyyy-MM-dd'), '</dct:issued>"
    "<dct:accrualPeriodicity><dct:Frequency><rdf:value><time:DurationDescription><time:months>3</time:months>"
    "</time:DurationDescription></rdf:value></dct:Frequency></dct:accrualPeriodicity>"
    "<dcat:distribution><dcat:Distribution rdf:about=\"http://x/about\"><dct:format><dct:IMT rdf:value=\"text/csv\"/></dct:format>"
    "<dcat:accessURL rdf:resource=\"http://x/', cast(o_orderkey as string), '.csv\"/></dcat:Distribution></dcat:distribution>"
    "<dcat:distribution><dcat:Distribution rdf:about=\"http://x/', cast(o_custkey as string), '\">"
    "<dct:format><dct:IMT rdf:value=\"application/x-unknown\"/></dct:format></dcat:Distribution></dcat:distribution>"
    "</dcat:Dataset></dcat:dataset>')"
)


def written_catalog(spark: SparkSession, sf_dir: str, entry: Column | None = None) -> str:
    target = f"{checkpoint_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    entry = F.expr(RDF) if entry is None else entry
    table(spark, sf_dir, "orders").select(entry.alias("value")).write.text(target)
    return target


@register("catalog_rejects", """
select o_orderkey, o_orderstatus <> 'P' as readable from orders""")
def catalog_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries that are read and those that are no XML: the ones of pending orders close an element they never open."""
    broken = F.replace(F.expr(RDF), F.lit("</dcat:Dataset>"), F.lit("</dct:lost></dcat:Dataset>"))
    path = written_catalog(spark, sf_dir, F.when(F.col("o_orderstatus") == "P", broken).otherwise(F.expr(RDF)))
    parsed = written_table(catalog_xml.parse_datasets(catalog_xml.dataset_fragments(spark, path)), "parsed")
    key = lambda c: F.regexp_extract(c, r"datos\.example/set/(\d+)", 1).cast("bigint").alias("o_orderkey")
    lost = catalog_xml.rejected_datasets(parsed).select(key("xml"), F.lit(False).alias("readable"))
    return catalog_xml.catalog_datasets(parsed).select(key("dataset_id"), F.lit(True).alias("readable")).unionByName(lost)


@register("catalog_scan_files", """
select 'http://datos.example/set/' || o_orderkey as dataset_id, 'Conjunto & ' || o_orderkey as dataset_title, 0 as idx,
       'CSV' as format, 'text/csv' as mime, 'http://x/' || o_orderkey || '.csv' as url from orders
union all select 'http://datos.example/set/' || o_orderkey, 'Conjunto & ' || o_orderkey, 1, 'OTRO', 'application/x-unknown',
       'http://x/' || o_custkey from orders""")
def catalog_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _datasets, files = catalog_xml.read_catalog(spark, written_catalog(spark, sf_dir))
    return files.select("dataset_id", "dataset_title", "idx", "format", "mime", "url")


@register("catalog_scan_datasets", """
select 'http://datos.example/set/' || o_orderkey as dataset_id, 'texto <b>con</b> <ol> ' || o_orderpriority as description,
       'Salud' as category, 'uno,dos' as keywords, 'CC-BY-4.0' as license, strftime(o_orderdate, '%Y-%m-%d') as issued,
       3.0::double as periodicity, 'CSV,OTRO' as formats from orders""")
def catalog_scan_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets, _files = catalog_xml.read_catalog(spark, written_catalog(spark, sf_dir))
    return datasets.select("dataset_id", "description", "category", F.array_join("keywords", ",").alias("keywords"),
                           "license", "issued", "periodicity", F.array_join("formats", ",").alias("formats"))
