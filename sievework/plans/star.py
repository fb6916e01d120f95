"""The audit tables derived from the driver tables, for Spark and as SQL text.

``*_sql`` hold the same derivation for the SQL check.  Attributes such as the
format or fetch status are computed from keys so that every branch of every
rule occurs; no row of the source table is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.operators import files as files_op
from sievework.operators.groups import key_counts, number_within

FORMAT_EXPR = (
    "case o_orderkey % 7 when 0 then 'CSV' when 1 then 'JSON' when 2 then 'XLSX' "
    "when 3 then 'SHP' when 4 then 'XML' when 5 then 'GML' else 'WMS' end"
)
FETCH_EXPR = (
    "case when o_orderkey % 7 = 6 then 'service' when o_orderkey % 11 = 0 then 'http_error' "
    "when o_orderkey % 11 = 1 then 'unreachable' when o_orderkey % 23 = 2 then 'too_large' "
    "when o_orderkey % 29 = 3 then 'no_url' when o_orderkey % 17 = 4 then 'truncated' "
    "else 'downloaded' end"
)
HTTP_EXPR = (
    "case when o_orderkey % 7 = 6 then null when o_orderkey % 11 = 0 then "
    "(case when o_orderkey % 2 = 0 then 404 else 500 end) when o_orderkey % 11 = 1 then null else 200 end"
)
# Two neighbouring datasets share addresses, and a dataset repeats some.
URL_EXPR = (
    "concat('https://files.example/d', cast(o_custkey - o_custkey % 2 as {s}), "
    "'/f', cast(o_orderkey % 6 as {s}))"
)
CODE_EXPR = (
    "case l_partkey % 13 when 0 then 'error-tipo' when 1 then 'encabezado-vacio' "
    "when 2 then 'encabezado-duplicado' when 3 then 'json-invalido' when 4 then 'no-es-archivo' "
    "when 5 then 'dependencia-faltante' when 6 then 'fila-duplicada' when 7 then 'fila-vacia' "
    "else 'celda-faltante' end"
)
SEVERITY_EXPR = (
    "case when code in ('celda-faltante', 'fila-duplicada') then 'warning' "
    "when code = 'dependencia-faltante' then 'info' else 'error' end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_nationkey").alias("publisher_id"),
        F.expr("cast(50 + (c_custkey % 51) as int)").alias("metadata_score"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File table without its position in the dataset (no shuffle needed)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.expr(FORMAT_EXPR).alias("format"),
        F.expr(URL_EXPR.format(s="string")).alias("url"),
        F.expr(FETCH_EXPR).alias("fetch_status"),
        F.expr(HTTP_EXPR).alias("http_status"),
        F.expr("cast(o_orderkey % 101 as int)").alias("score"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("size_bytes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File table with ``idx``, the 0-based position inside the dataset."""
    numbered = number_within(raw_files(spark, sf_dir), ["dataset_id"], "file_id", "idx", sparse=True)
    return numbered.withColumn("idx", (F.col("idx") - 1).cast("int"))


def files_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per dataset, from one column of the file table."""
    return key_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset_id")), ["dataset_id"])


def content_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysers found: one row per (file, code)."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.expr(CODE_EXPR).alias("code"),
        F.expr("cast(floor(l_quantity) as bigint)").alias("n"),
    )
    grouped = lines.groupBy("file_id", "code").agg(F.sum("n").alias("count"))
    return grouped.select("file_id", "code", F.expr(SEVERITY_EXPR).alias("severity"), "count")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyser findings plus the issues that follow from a failed fetch."""
    fetch = files_op.issues_from_fetch(raw_files(spark, sf_dir)).filter("issue_code is not null")
    return content_issues(spark, sf_dir).unionByName(fetch.select(
        "file_id", F.col("issue_code").alias("code"), F.col("issue_severity").alias("severity"),
        F.lit(1).cast("bigint").alias("count"),
    ))


def audited_files(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Files with codes, status, delivery state and cause.

    The fetch issue is appended to the array in the row; only the analyser
    findings need the one shuffle by file.
    """
    base = files_op.issues_from_fetch((files if numbered else raw_files)(spark, sf_dir))
    is_error = F.col("severity") == "error"
    found = content_issues(spark, sf_dir).groupBy("file_id").agg(
        F.collect_set("code").alias("codes"),
        F.array_sort(F.collect_set(F.when(is_error & ~F.col("code").isin(*dims.BLOCKING_CODES),
                                          F.col("code")))).alias("error_codes"),
        F.count_if(is_error).alias("error_kinds"),
    )
    joined = base.join(found, "file_id", "left").withColumns({
        "codes": F.array_sort(F.array_compact(F.array_append(
            F.coalesce("codes", files_op.empty_codes()), F.col("issue_code")))),
        "error_codes": F.coalesce("error_codes", files_op.empty_codes()),
        "status": F.coalesce("fetch_decides", D.file_status(
            F.coalesce("error_kinds", F.lit(0)) == 0, F.coalesce("codes", files_op.empty_codes()))),
    })
    return files_op.classify_delivery(joined).drop("fetch_decides", "issue_code", "issue_severity")


# --- the same derivation as SQL text ----------------------------------------
_BLOCKING = (
    "'descarga','error-fuente','no-es-archivo','archivo-vacio','servicio-no-disponible',"
    "'servicio-error','no-es-imagen','formato-no-esperado','json-invalido','xml-no-bien-formado',"
    "'xlsx-invalido','zip-invalido','tipo-no-identificado','error-validacion','error-esquema',"
    "'ical-invalido','firma-invalida','geojson-invalido','raiz-invalida','imagen-corrupta',"
    "'shp-faltante','zip-extraccion','shp-lectura'"
)
_LIMITATION = (
    "'dependencia-faltante','fallo-analizador','error-validacion','descarga-truncada',"
    "'too_large','paquete-desproporcionado'"
)

DATASETS_SQL = """
ds as (
  select c_custkey as dataset_id, c_name as title, c_mktsegment as category,
         c_nationkey as publisher_id, cast(50 + (c_custkey % 51) as int) as metadata_score
  from customer)"""

CONTENT_ISSUES_SQL = f"""
found as (
  select file_id, code, {SEVERITY_EXPR} as severity, cast(sum(n) as bigint) as count
  from (select l_orderkey as file_id, {CODE_EXPR} as code,
               cast(floor(l_quantity) as bigint) as n from lineitem) x
  group by file_id, code)"""

ISSUES_SQL = f"""{CONTENT_ISSUES_SQL},
iss as (
  select * from found union all
  select o_orderkey, 'descarga', 'error', cast(1 as bigint) from orders
  where {FETCH_EXPR} in ('http_error', 'unreachable'))"""

FILES_SQL = f"""
raw as (
  select o_orderkey as file_id, o_custkey as dataset_id,
         cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as idx,
         {FORMAT_EXPR} as format, {URL_EXPR.format(s='varchar')} as url, {FETCH_EXPR} as fetch_status,
         {HTTP_EXPR} as http_status, cast(o_orderkey % 101 as int) as score,
         cast(floor(o_totalprice) as bigint) as size_bytes
  from orders),{ISSUES_SQL},
agg as (
  select file_id, list(code order by code) as codes,
         count(*) filter (where severity = 'error') as error_kinds,
         coalesce(list(code order by code) filter (where severity = 'error' and code not in ({_BLOCKING})), []) as error_codes,
         max(case when code in ('no-es-archivo','no-es-imagen') then 1 else 0 end) as naf,
         max(case when code in ({_BLOCKING}) then 1 else 0 end) as blk,
         max(case when code in ({_LIMITATION}) then 1 else 0 end) as lim,
         min(case when code in ({_BLOCKING}) then code end) as first_blk,
         min(case when code in ({_LIMITATION}) then code end) as first_lim,
         min(code) as first_code
  from iss group by file_id),
st as (
  select raw.*, error_kinds, coalesce(codes, []) as codes, coalesce(error_codes, []) as error_codes, first_blk, first_lim, first_code,
         coalesce(naf, 0) as naf, coalesce(blk, 0) as blk, coalesce(lim, 0) as lim,
         case when fetch_status in ('no_url','too_large') then 'skipped'
              when fetch_status in ('http_error','unreachable') then 'error'
              when coalesce(error_kinds, 0) = 0 then 'ok'
              when coalesce(lim, 0) = 1 or coalesce(naf, 0) = 1 then 'skipped' else 'error' end as status
  from raw left join agg using (file_id)),
fs as (
  select *, case when naf = 1 then 'no-entrega'
                 when fetch_status in ('http_error','unreachable') then 'roto'
                 when fetch_status in ('too_large','no_url','error') then 'omitida'
                 when blk = 1 then 'roto' when lim = 1 then 'no-analizado'
                 when status in ('ok','error') then 'ok' else 'omitida' end as state
  from st),
files as (
  select *, case when state = 'ok' then null
                 when fetch_status in ('too_large','no_url','error') then fetch_status
                 else coalesce(first_blk, first_lim,
                      case when fetch_status not in ('downloaded','truncated','service') then fetch_status end,
                      first_code, 'desconocido') end as cause
  from fs)"""

STAR_SQL = f"with {FILES_SQL.strip()},{DATASETS_SQL}"
