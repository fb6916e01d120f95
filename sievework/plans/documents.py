"""Document, payload, geometry, sink and stream queries.

JSON, XML, calendar and package documents are composed row by row from the
tables, so their number grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import geo as G
from sievework.functions import sniff as SN
from sievework.functions import text as T
from sievework.functions.cells import cell_text
from sievework.functions.json_text import describe
from sievework.operators import collection as CO
from sievework.operators import defects as DF
from sievework.operators import documents as DO
from sievework.plans import star
from sievework.plans.star import STAR_SQL, table
from sievework.session import checkpoint_dir, written_table
from sievework.sources import reports as RP
from sievework.streaming import arrivals

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- payloads ------------------------------------------------------------------
BODY = (
    "case page_id % 8 when 0 then html when 1 then concat('  {{\"u\":\"', url, '\"}}') when 2 then concat('<?xml version=\"1.0\"?><r>', url, '</r>') "
    "when 3 then concat('PK', chr(3), chr(4), url) when 4 then '' "
    "when 5 then concat('<ows:ExceptionReport><ows:Exception exceptionCode=\"NoCode\" locator=\"L', cast(page_id as {s}), '\"><ows:ExceptionText> no  layer </ows:ExceptionText></ows:Exception></ows:ExceptionReport>') "
    "when 6 then url else concat(chr(7), chr(1), url) end"
)
STATUS = "case when page_id % 16 = 9 then 404 when page_id % 16 = 14 then 503 when page_id % 16 = 8 then 403 else 200 end"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr(BODY.format(s="string")).cast("binary").alias("content"), F.expr(STATUS).alias("http_status"))


@register("payload_sniff", """
select page_id, case page_id % 8 when 0 then 'html' when 1 then 'json' when 2 then 'xml' when 3 then 'zip' when 4 then 'vacio'
   when 5 then 'xml' when 6 then 'texto' else 'binario' end as kind, page_id % 8 = 0 as is_html,
   case page_id % 8 when 0 then 'html' when 1 then 'json' when 2 then 'xml' when 3 then 'zip' end as detected
from pages""")
def payload_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(spark, sf_dir)
    return p.select("page_id", SN.sniff(F.col("content")).alias("kind"),
                    SN.looks_like_html(F.col("content")).alias("is_html"), SN.detected_type(F.col("content")).alias("detected"))


@register("payload_diagnosis", f"""
with p as (select page_id, page_id % 8 as k, {STATUS} as st from pages)
select page_id, case when k = 5 then 'service-exception' when st = 404 then 'gone' when st = 403 then 'denied' when st = 503 then 'server-error'
   when k = 4 then 'empty' when k = 0 then 'web-page' when k = 2 then 'xml-document' when k = 1 then 'json-document'
   when k = 3 then 'truncated-zip' else 'other-content' end as reason,
  case when k = 5 then 'no layer (NoCode, parámetro L' || page_id || ')' when st <> 200 then null when k = 6 then 'texto' when k = 7 then 'binario' end as detail,
  case when k = 3 and st = 200 then 'portal' when k in (6, 7) and st = 200 then 'desconocido' else 'publicador' end as origin from p""")
def payload_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(spark, sf_dir).withColumn("d", SN.diagnose_payload(F.col("content"), F.col("http_status")))
    return p.select("page_id", "d.reason", "d.detail", "d.origin")


@register("type_conformance", """
with p as (select page_id, page_id % 8 as k, (['BIN','HTML','JSON','XML','ZIP'])[page_id % 5 + 1] as declared from pages),
d as (select *, case k when 0 then 'html' when 1 then 'json' when 2 then 'xml' when 3 then 'zip' end as det from p)
select page_id, case when det is null or det = 'html' then 0 when declared = 'BIN' then 80 when lower(declared) = det then 100 else 60 end as score,
  case when det is null then 'tipo-no-identificado' when det = 'html' then 'no-es-archivo' when declared = 'BIN' then 'tipo-detectado' end as code,
  not (det is null or det = 'html') as ok from d""")
def type_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.expr("element_at(array('BIN','HTML','JSON','XML','ZIP'), cast(page_id % 5 + 1 as int))")
    p = payloads(spark, sf_dir).withColumn("c", SN.type_conformance(declared, SN.detected_type(F.col("content"))))
    return p.select("page_id", "c.score", "c.code", "c.ok")


@register("page_types", """
select 'html' as detected, 0 as score, count(*) as pages from pages where regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html)')""")
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real pages through the conformance check."""
    pages = table(spark, sf_dir, "pages")
    found = SN.detected_type(F.col("html"))
    return pages.select(found.alias("detected"), SN.type_conformance(F.lit("CSV"), found)["score"].alias("score")).groupBy(
        "detected", "score").agg(F.count(F.lit(1)).alias("pages"))


@register("encoding_errors", """
select page_id from pages where html like '%�%' union all select page_id from pages where page_id % 3 = 1 and regexp_matches(html, '[\\x80-\\xFF]')
  and not html like '%�%'""")
def encoding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bytes are not UTF-8; every third is stored as ISO-8859-1."""
    pages = table(spark, sf_dir, "pages")
    latin = F.encode(F.translate(F.regexp_replace("html", "[^\\x00-\\xFF]", "?"), "", ""), "ISO-8859-1").cast("string")
    stored = pages.select("page_id", F.when(F.col("page_id") % 3 == 1, latin).otherwise(F.col("html")).alias("value"))
    return DF.encoding_errors(stored).select("page_id")


# --- JSON ------------------------------------------------------------------------
JSON_DOC = """case event_id % 5
  when 0 then concat('{"meta":{"n":', cast(event_id as string), '},"tags":["a","b","c"],"result":{"items":[', props, ',{"k":', cast(user_id as string), ',"z":"x"},{"z":null}],"other":[[1]]}}')
  when 1 then concat('[{"element":', props, '},{"element":{"k":', cast(user_id as string), '}}]')
  when 2 then concat('{"a":{"list":[{"atributo":[{"name":"CP","valor":"0', cast(event_id as string), '"},{"name":"T","string":"u"},{"name":"T","string":"v"}]},{"atributo":[{"name":"CP","text":null}]}]}}')
  when 3 then concat('[[1,true,"', event_type, '"],[', cast(user_id as string), ']]')
  else concat('{"v":', cast(event_id as string), ',"s":"[{}]"}') end"""


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.expr(JSON_DOC).alias("text"))


_K = "cast(json_extract(props, '$.k') as varchar)"


@register("json_records", """
select event_id as file_id, case event_id % 5 when 0 then 'result.items' when 1 then '[].element' when 2 then 'a.list[].atributo' else '' end as path,
  case event_id % 5 when 2 then 'pairs' when 3 then 'lists' else 'objects' end as layout,
  cast(case event_id % 5 when 0 then 3 else 2 end as int) as n from events where event_id % 5 <> 4""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = DO.json_records(json_docs(spark, sf_dir))
    return records.select("file_id", "path", "layout", F.size("items").alias("n"))


@register("json_rows", f"""
select event_id as file_id, cast(2 as bigint) as row_no, 'k' as header, {_K} as tokens, false as irregular from events where event_id % 5 = 0
union all select event_id, 3, 'k', cast(user_id as varchar), false from events where event_id % 5 = 0
union all select event_id, 4, 'k', '', true from events where event_id % 5 = 0
union all select event_id, 2, 'k', {_K}, false from events where event_id % 5 = 1
union all select event_id, 3, 'k', cast(user_id as varchar), false from events where event_id % 5 = 1
union all select event_id, 2, 'CP|T', '0' || event_id || '|u · v', false from events where event_id % 5 = 2
union all select event_id, 3, 'CP|T', '|', true from events where event_id % 5 = 2
union all select event_id, 2, 'Columna 1|Columna 2|Columna 3', '1|true|' || event_type, false from events where event_id % 5 = 3
union all select event_id, 3, 'Columna 1|Columna 2|Columna 3', cast(user_id as varchar), false from events where event_id % 5 = 3""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DO.record_rows(DO.json_records(json_docs(spark, sf_dir)))
    return rows.select("file_id", "row_no", F.array_join("header", "|").alias("header"),
                       F.array_join("tokens", "|").alias("tokens"), "irregular")


@register("json_tables", """
select event_id as file_id, cast(case event_id % 5 when 0 then 3 else 2 end as bigint) as rows,
  cast(case event_id % 5 when 2 then 2 when 3 then 3 else 1 end as int) as columns,
  cast(case event_id % 5 when 0 then 1 when 2 then 1 else 0 end as bigint) as irregular_records from events where event_id % 5 <> 4""")
def json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DO.record_rows(DO.json_records(json_docs(spark, sf_dir)))
    return DO.record_tables(rows).select("file_id", "rows", "columns", "irregular_records")


@register("json_audit", """
with u as (select user_id, count(*) as n, count(*) filter (where event_type = 'error') as e,
                  count(*) filter (where event_type = 'click') as c from events group by user_id),
v as (select user_id as file_id, n as rows, c, e, n - c - e as num from u)
select file_id, rows, num as numbers, c as empties,
  cast(case when num + e >= 3 and num > e then e else 0 end as bigint) as type_errors,
  cast(case when (num + e) * 1.0 / rows >= 0.5 then c else 0 end as bigint) as missing,
  cast(100 - case when num + e >= 3 and num > e and e > 0 then 15 else 0 end
       - case when (num + e) * 1.0 / rows >= 0.5 and c > 0 then 5 else 0 end as int) as score from v""")
def json_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record table per user: numbers, some words in error events, some blanks."""
    raw = F.expr("case event_type when 'error' then 'N/D' when 'click' then '' else cast(cast(value as decimal(18,2)) as string) end")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), (F.col("event_id") + 2).alias("row_no"),
        F.array(F.lit("value")).alias("header"), F.array(raw).alias("tokens"))
    audit = DF.audit_records(rows)
    found = audit["issues"].groupBy("file_id").agg(
        F.sum(F.when(F.col("code") == "error-tipo", F.col("count")).otherwise(0)).alias("type_errors"),
        F.sum(F.when(F.col("code") == "celda-faltante", F.col("count")).otherwise(0)).alias("missing"))
    numbers = rows.groupBy("file_id").agg(
        F.count_if(F.get("tokens", F.lit(0)).rlike("^[0-9.-]+$")).alias("numbers"),
        F.count_if(F.get("tokens", F.lit(0)) == "").alias("empties"))
    return audit["files"].join(numbers, "file_id").join(found, "file_id", "left").select(
        "file_id", "rows", "numbers", "empties", F.coalesce("type_errors", F.lit(0).cast("bigint")).alias("type_errors"),
        F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"), "score")


@register("json_shapes", """
select event_id as file_id, case when event_id % 5 in (1, 3) then 'list' else 'object' end as kind,
  cast(case when event_id % 5 in (1, 3) then 2 end as int) as elements,
  cast(case event_id % 5 when 0 then 3 when 2 then 1 when 4 then 2 end as int) as top_keys,
  cast(case event_id % 5 when 0 then 3 when 2 then 1 when 4 then 0 end as int) as nested_values,
  case event_id % 5 when 0 then 'Objeto · 3 claves' when 2 then 'Objeto · 1 claves' when 4 then 'Objeto · 2 claves' else 'Array · 2 elementos' end as description
from events""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DO.json_outcome(json_docs(spark, sf_dir)).select(
        "file_id", "kind", "elements", "top_keys", "nested_values", describe(F.col("text")).alias("description"))


@register("json_search", """
select event_id as file_id, 'result.items[1].z' as path from events where event_id % 5 = 0
union all select event_id, 'result.items[2].z' from events where event_id % 5 = 0""")
def json_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DO.search_json(DO.json_nodes(json_docs(spark, sf_dir)), " Z ").select("file_id", "path")


# One branch per event, up to eleven levels of objects and lists in turn deep, every 13th cut short.
_NESTED = """concat('{"event":"', event_type, '","in":', repeat('{"d":[0,', cast(event_id % 6 as int)), props,
  repeat(']}', cast(event_id % 6 as int)), ',"at":[', cast(user_id as string), ',true,null,{"s":"[{}]"}]', if(event_id % 13 = 0, '', '}'))"""
_NESTED_SQL = """with d as (select event_id as doc_id, concat('{"event":"', event_type, '","in":', repeat('{"d":[0,', event_id % 6), props,
  repeat(']}', event_id % 6), ',"at":[', user_id, ',true,null,{"s":"[{}]"}]', case when event_id % 13 = 0 then '' else '}' end) as body from events),
t as (select d.doc_id as file_id, regexp_replace(n.fullkey, '^\\$\\.?', '') as path, n.key as name, n.type as kind,
        case when n.type not in ('OBJECT', 'ARRAY') then coalesce(n.atom->>'$', 'null') end as leaf
      from d, json_tree(case when json_valid(d.body) then d.body end) n where n.parent is not null),
u as (select file_id, path, case when path like '%]' then null else name end as name, leaf from t)"""


def nested_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.expr(_NESTED).alias("text"))


@register("json_nodes", f"{_NESTED_SQL} select file_id, path, name, leaf from u")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of documents of many depths."""
    return DO.json_nodes(nested_docs(spark, sf_dir)).select("file_id", "path", "name", "leaf")


@register("json_open_paths", f"""{_NESTED_SQL},
hit as (select file_id, path from u where contains(lower(coalesce(name, '')), 'k') or contains(lower(coalesce(leaf, '')), 'k')),
above as (select h.file_id, a.path, h.path as hit from hit h join u a on a.file_id = h.file_id and a.leaf is null
            and (starts_with(h.path, a.path || '.') or starts_with(h.path, a.path || '[')) union all select file_id, '', path from hit)
select file_id, path, count(*) as hits from above group by file_id, path""")
def json_open_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches to unfold for the hits of a search."""
    return DO.open_json_paths(DO.search_json(DO.json_nodes(nested_docs(spark, sf_dir)), "K"))


GEOJSON = """case event_id % 4 when 0 then concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":', props, '},{"type":"Feature","geometry":null}]}')
  when 1 then concat('{"type":"FeatureCollection","features":[', if(event_id % 8 = 1, '', '{"type":"Feature","geometry":{"type":"Point"}}'), ']}')
  when 2 then if(event_id % 8 = 2, '{"type":"Point","coordinates":[1,2]}', '{"type":"Nada"}') else if(event_id % 8 = 3, '[1]', '{"type":') end"""


@register("geojson_features", """
select event_id, case event_id % 4 when 0 then 2 when 1 then case when event_id % 8 = 1 then 0 else 1 end end as features,
  case event_id % 4 when 0 then 1 when 1 then 0 end as null_geometries,
  case event_id % 8 when 0 then 'geometria-nula' when 4 then 'geometria-nula' when 1 then 'sin-features' when 6 then 'tipo-desconocido'
    when 3 then 'raiz-invalida' when 7 then 'geojson-invalido' end as code,
  case event_id % 8 when 0 then 85 when 4 then 85 when 1 then 90 when 5 then 100 when 2 then 100 else 0 end as score from events""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "events").select("event_id", F.expr(GEOJSON).alias("text"), "props")
    return DO.geojson_features(docs).select("event_id", "features", "null_geometries", "code", "score")


# --- XML, calendars, packages -------------------------------------------------------
XML_DOC = """case o_orderkey % 6
  when 0 then concat('<?xml version="1.0"?><rss><channel>', repeat('<item>a</item>', cast(o_orderkey % 4 as int)), '</channel></rss>')
  when 1 then concat('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>A & B</name><Point/></Placemark>', repeat('<Placemark/>', cast(o_orderkey % 3 as int)), '</kml>')
  when 2 then '<kml><Placemark/></kml>'
  when 3 then concat('<rdf:RDF xmlns:rdf="r" xmlns:d="d"><d:Catalog>', repeat('<d:Dataset/>', cast(o_orderkey % 5 as int)), '</d:Catalog></rdf:RDF>')
  when 4 then concat('<g:c xmlns:g="http://www.opengis.net/gml">', repeat('<g:member><g:Point/></g:member>', cast(o_orderkey % 3 as int)), if(o_orderkey % 4 = 0, '<g:featureMember/>', ''), '</g:c>')
  else if(o_orderkey % 12 = 5, '<a><b></a>', '<a><b/></a>') end"""
SERVICE_DOC = """case when s_suppkey % 5 = 0 then '<ServiceExceptionReport/>' else concat('<x:WMS_Capabilities xmlns:x="u">',
        repeat(if(s_suppkey % 2 = 0, '<x:Layer/>', '<x:FeatureType/>'), cast(s_suppkey % 3 as int)), '</x:WMS_Capabilities>') end"""
CALENDAR_DOC = """if(c_custkey % 7 = 0, concat('X:1\\n', if(c_custkey % 4 = 0, 'no colon here\\n', '')), concat('BEGIN:VCALENDAR\\r\\nSUMMARY:long\\r\\n  folded ', c_name, '\\r\\n',
        repeat('BEGIN:VEVENT\\r\\nUID;X=1:a\\r\\nEND:VEVENT\\r\\n', cast(c_custkey % 3 as int)), if(c_custkey % 4 = 0, 'no colon here\\r\\n', ''), 'END:VCALENDAR\\r\\n'))"""
KINDS = "element_at(array('RSS','KML','KML','RDF','GML','XML'), cast(o_orderkey % 6 + 1 as int))"


@register("xml_inventory", """
with x as (select o_orderkey as file_id, (['RSS','KML','KML','RDF','GML','XML'])[o_orderkey % 6 + 1] as kind, o_orderkey % 6 as k from orders),
e as (select *, case k when 0 then file_id % 4 when 1 then 1 + file_id % 3 when 2 then 1 when 3 then 1 + file_id % 5
        when 4 then case when file_id % 4 = 0 then 1 else file_id % 3 end end as entities,
      not (k = 5 and file_id % 12 = 5) as well_formed, k = 1 as repaired,
      case k when 0 then 2 + file_id % 4 when 1 then 4 + file_id % 3 when 2 then 2 when 3 then 2 + file_id % 5
        when 4 then 1 + 2 * (file_id % 3) + case when file_id % 4 = 0 then 1 else 0 end else case when file_id % 12 = 5 then null else 2 end end as total from x)
select file_id, kind, well_formed, repaired, cast(total as int) as total_elements, cast(entities as int) as entities,
  case when not well_formed then 'xml-no-bien-formado' when k = 2 then 'raiz-invalida' when entities = 0 then 'sin-entidades' when repaired then 'xml-reparado' end as code,
  case when not well_formed or k = 2 or entities = 0 then 0 else 100 end as score from e""")
def xml_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.expr(KINDS).alias("kind"), F.expr(XML_DOC).alias("text"))
    return DO.score_xml(DO.xml_inventory(docs)).select(
        "file_id", "kind", "well_formed", "repaired", "total_elements", "entities", "code", "score")


@register("service_inventory", """
select s_suppkey as file_id, case when s_suppkey % 2 = 0 then 'WMS' else 'WFS' end as service,
  cast(case when s_suppkey % 5 = 0 then null else s_suppkey % 3 end as int) as offered,
  case when s_suppkey % 5 = 0 then 'servicio-no-disponible' when s_suppkey % 3 = 0 then case when s_suppkey % 2 = 0 then 'sin-capas' else 'sin-feature-types' end end as code,
  case when s_suppkey % 5 = 0 then 0 when s_suppkey % 3 = 0 then 50 else 100 end as score from supplier""")
def service_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("file_id"), F.expr("if(s_suppkey % 2 = 0, 'WMS', 'WFS')").alias("service"), F.expr(SERVICE_DOC).alias("text"))
    return DO.service_inventory(DO.xml_inventory(docs)).select("file_id", "service", "offered", "code", "score")


@register("calendars", """
select c_custkey as file_id, cast(case when c_custkey % 7 = 0 then 0 else c_custkey % 3 end as int) as events,
  cast(case when c_custkey % 4 = 0 then 1 else 0 end as int) as bad_lines,
  case when c_custkey % 7 = 0 then 'ical-invalido' else array_to_string(list_filter([case when c_custkey % 4 = 0 then 'errores-linea' end,
    case when c_custkey % 3 = 0 then 'sin-eventos' end], lambda x: x is not null), ',') end as codes,
  cast(case when c_custkey % 7 = 0 then 0 else 100 - 5 * ((c_custkey % 4 = 0)::int + (c_custkey % 3 = 0)::int) end as int) as score from customer""")
def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.expr(CALENDAR_DOC).alias("text"))
    return DO.audit_calendars(docs).select("file_id", "events", "bad_lines", F.array_join("codes", ",").alias("codes"), "score")


MEMBER = "concat('F', cast(l_partkey % 3 as {s}), case l_linenumber % 5 when 0 then '.SHP' when 1 then '.dbf' when 2 then '.shx' when 3 then '.prj' else '.txt' end)"


@register("manifests", """
with m as (select l_orderkey, l_linenumber % 5 as e, cast(l_extendedprice * 10000 as bigint) as size, cast(l_orderkey % 9 * 3000000 as bigint) as zip_size from lineitem),
g as (select l_orderkey as archive_id, bool_or(e = 0) as shp, bool_or(e = 1) as dbf, bool_or(e = 2) as shx, bool_or(e = 3) as prj,
       cast(sum(size) as bigint) as inflated, max(zip_size) as z from m group by 1)
select archive_id, inflated, array_to_string(list_filter([case when not shp then '.shp' end, case when not dbf then '.dbf' end,
   case when not shx then '.shx' end], lambda x: x is not null), ',') as missing_parts, prj as has_projection,
  case when not shp then 'shp-faltante' when inflated > least(8589934592, greatest(67108864, z * 50)) then 'paquete-desproporcionado' end as code from g""")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("archive_id"), F.expr(MEMBER.format(s="string")).alias("name"),
        F.expr("cast(round(l_extendedprice * 10000) as bigint)").alias("size"),
        F.expr("cast(l_orderkey % 9 * 3000000 as bigint)").alias("zip_size"))
    return DO.audit_manifest(members).select(
        "archive_id", "inflated", F.array_join("missing_parts", ",").alias("missing_parts"), "has_projection", "code")


@register("feature_layers", """
with f as (select o_custkey as layer_id, count(*) as features, count(*) filter (where o_orderpriority = '1-URGENT') as null_geometries from orders group by 1),
l as (select c_custkey as layer_id, c_custkey % 4 as miss, c_custkey % 2 = 0 as prj from customer),
j as (select l.*, coalesce(features, 0) as features, coalesce(null_geometries, 0) as null_geometries from l left join f using (layer_id))
select layer_id, features, null_geometries, cast(case when features = 0 then 0 else greatest(0, 100 - 5 * ((miss in (1, 3))::int + (miss = 3)::int + (not prj)::int)
  - case when null_geometries > 0 then 15 else 0 end) end as int) as score,
  not (miss = 2 or null_geometries > 0 or features = 0) as ok from j""")
def feature_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("layer_id"), (F.col("o_orderkey") + 1).alias("record_no"),
        F.expr("if(o_orderpriority = '1-URGENT', null, 'POINT(1 2)')").alias("geometry"))
    missing = "case c_custkey % 4 when 1 then array('.dbf') when 2 then array('.shp') when 3 then array('.dbf', '.shx') else cast(array() as array<string>) end"
    layers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("layer_id"), F.expr(missing).alias("missing_parts"), (F.col("c_custkey") % 2 == 0).alias("has_projection"))
    return DO.score_layers(layers, features).select("layer_id", "features", "null_geometries", "score", "ok")


@register("null_geometry_rows", "select o_custkey as file_id, o_orderkey + 1 as row_no from orders where o_orderpriority = '1-URGENT'")
def null_geometry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("layer_id"), (F.col("o_orderkey") + 1).alias("record_no"),
        F.expr("if(o_orderpriority = '1-URGENT', null, 'POINT(1 2)')").alias("geometry"))
    return DO.null_geometries(features).select("file_id", "row_no")


# --- geometry ------------------------------------------------------------------------
WKT = ('PROJCS["ETRS_1989_UTM_Zone_30N",GEOGCS["G",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]]],'
       'PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],'
       'PARAMETER["Central_Meridian",-3.0],PARAMETER["Scale_Factor",0.9996],UNIT["Meter",1.0]]')
# The same closed form in SQL, constants of the ellipsoid folded by hand.
TM_SQL = """
with k as (select 6378137.0::double as a, 1.0::double / 298.257222101::double as f),
k1 as (select a, f * 2 - f * f as e2 from k),
k2 as (select *, (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) as n, e2 / (1 - e2) as ep2 from k1),
p as (select c_custkey, 300000.0::double + (c_custkey % 400) * 1000.0::double as x, 4400000.0::double + (c_custkey % 300) * 1000.0::double as y from customer),
q as (select *, y / 0.9996::double / (a * (1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256)) as mu from p, k2),
r as (select *, mu + (3 * n / 2 - 27 * n * n * n / 32) * sin(2 * mu) + (21 * n * n / 16 - 55 * n * n * n * n / 32) * sin(4 * mu)
   + (151 * n * n * n / 96) * sin(6 * mu) + (1097 * n * n * n * n / 512) * sin(8 * mu) as ft from q),
s as (select *, ep2 * cos(ft) * cos(ft) as c, tan(ft) * tan(ft) as t, 1 - e2 * sin(ft) * sin(ft) as w from r),
u as (select *, a / sqrt(w) as nu, a * (1 - e2) / (w * sqrt(w)) as rho from s),
v as (select *, (x - 500000) / (nu * 0.9996::double) as d from u)
select c_custkey, round((ft - (nu * tan(ft) / rho) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d * d * d * d / 24
    + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d * d * d * d * d * d / 720)) * 180 / pi(), 6) as lat,
  round(-3.0 + ((d - (1 + 2 * t + c) * d * d * d / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d * d * d * d * d / 120) / cos(ft)) * 180 / pi(), 6) as lon,
  true as plausible, 'ETRS 1989 UTM Zone 30N' as name from v"""


@register("reproject_points", TM_SQL)
def reproject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 400 * 1000.0 + 300000.0).alias("x"),
        (F.col("c_custkey") % 300 * 1000.0 + 4400000.0).alias("y"), F.lit(WKT).alias("wkt"))
    located = G.inverse_mercator(points.withColumn("p", G.projection_of(F.col("wkt"))), "p", "x", "y")
    return located.select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                          G.is_plausible(F.col("lon"), F.col("lat")).alias("plausible"),
                          G.projection_name(F.col("wkt")).alias("name"))


@register("rings", """
with r as (select o_custkey as shape_id, o_orderkey as ring_no, case when o_orderkey % 9 = 0 then 3 else 4 end as np,
       (case when o_orderkey % 3 = 0 then 1.0 else -1.0 end) * (1 + o_orderkey % 5) * 2.0 as area from orders),
v as (select *, row_number() over (partition by shape_id order by ring_no) as k from r where np >= 4),
o as (select *, case when area >= 0 or k = 1 then 1 else 0 end as opens from v)
select shape_id, ring_no, area::double as area, opens = 0 as is_hole,
       cast(sum(opens) over (partition by shape_id order by ring_no) as bigint) as polygon from o""")
def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of varying width, every third the other way round."""
    w = "cast(1 + o_orderkey % 5 as double)"
    point = "named_struct('x', cast({x} as double), 'y', cast({y} as double))"
    a, b, c, d = (point.format(x=x, y=y) for x, y in (("0", "0"), ("0", "2"), (w, "2"), (w, "0")))
    ring = f"case when o_orderkey % 9 = 0 then array({a}, {b}, {c}) when o_orderkey % 3 = 0 then array({a}, {d}, {c}, {b}) else array({a}, {b}, {c}, {d}) end"
    shapes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("shape_id"), F.col("o_orderkey").alias("ring_no"), F.expr(ring).alias("ring"))
    sized = shapes.withColumns({"area": G.signed_area(F.col("ring")), "n_points": F.size("ring")})
    return DO.rings_to_polygons(sized).select("shape_id", "ring_no", "area", "is_hole", "polygon")


@register("boxes", """
with b as (select c_custkey, (c_custkey % 300) - 150.0::double as w, (c_custkey % 160) - 80.0::double as s from customer)
select c_custkey, w - 3.0 as west, greatest(-90.0::double, s - 3.0) as south, w + 13.0 as east, least(90.0::double, s + 13.0) as north,
  s + 12.0 <= 90 as contains_shifted from b""")
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-degree boxes padded by the default factor; do they hold a shifted copy?"""
    w, s = F.col("c_custkey") % 300 - 150.0, F.col("c_custkey") % 160 - 80.0

    def box(dx: float) -> F.Column:
        return F.struct((w + dx).alias("west"), (s + dx).alias("south"), (w + 10 + dx).alias("east"), (s + 10 + dx).alias("north"))

    padded = table(spark, sf_dir, "customer").select("c_custkey", G.pad_box(box(0.0)).alias("b"), box(2.0).alias("shifted"))
    return padded.select("c_custkey", "b.*", G.box_contains(F.col("b"), F.col("shifted")).alias("contains_shifted"))


# --- export, report and checkpoint sinks --------------------------------------------
EXPORT = "case o_orderkey % 6 when 0 then concat('=', o_orderpriority) when 1 then '-12,5' when 2 then concat('-', o_orderpriority) when 3 then 'a;b\"c' when 4 then null else o_orderpriority end"


@register("csv_export", """
select cast(o_orderkey as varchar) || ';' || case o_orderkey % 6 when 0 then chr(39) || '=' || o_orderpriority when 1 then '-12,5'
   when 2 then chr(39) || '-' || o_orderpriority when 3 then '"a;b""c"' when 4 then '' else o_orderpriority end as line from orders""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported lines read back from the files, headers and marks removed."""
    target = scratch(spark, "export")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(EXPORT).alias("note"))
    RP.export_csv(rows, target)
    lines = spark.read.option("lineSep", "\r\n").text(target)
    return lines.filter(~F.col("value").endswith("key;note")).select(F.col("value").alias("line"))


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File results in report shape; issues per file are bounded by the code vocabulary.

    Files meet their issues once, in a narrow table in the shared folder; the report's shape is put on as it is read.
    """
    none = F.lit(None)

    def issue(found: Column) -> Column:
        located = found["code"].isin(*dims.HIGH_IMPACT_CODES)
        return F.struct(
            found["code"].alias("code"), F.lit("").alias("label"), found["severity"].alias("severity"), found["count"].alias("count"),
            F.when(located, found["count"]).otherwise(0).cast("bigint").alias("stored"),
            none.cast("string").alias("source"),
            F.when(located, F.array(F.struct(
                none.cast("string").alias("sheet"), F.lit(1).alias("col"), F.lit("c").alias("field"),
                F.array(found["count"]).alias("rows"), none.cast("array<string>").alias("cells")))).alias("columns"),
            none.cast("array<bigint>").alias("rows"),
            none.cast("array<struct<row: bigint, field: string, cell: string>>").alias("samples"))

    # A code stands once in a file, so the order of the structs is that of the codes.
    per_file = star.content_issues(spark, sf_dir).groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("code", "severity", "count"))).alias("found"))
    met = written_table(star.raw_files(spark, sf_dir).join(per_file, "file_id", "left"), "results")
    files = met.withColumn("issues", F.transform("found", issue))
    url = F.concat("url", F.lit("?"), F.col("file_id").cast("string"))
    profile = "array<struct<name: string, type: string, null_count: bigint, null_pct: double, distinct: bigint>>"
    return files.select(
        F.col("dataset_id").cast("string").alias("dataset_id"), F.lit(0).alias("idx"), "format", F.lit("").alias("mime"),
        url.alias("url"), F.lit("ok").alias("status"),
        F.struct(F.col("fetch_status").alias("status"), F.col("size_bytes").alias("size"), "http_status",
                 F.lit(False).alias("truncated"), F.lit("").alias("note"), url.alias("final_url")).alias("fetch"),
        F.when(F.col("issues").isNotNull(), F.struct(
            F.lit(True).alias("ok"), "score", F.lit("").alias("summary"), F.lit(False).alias("truncated"), "issues",
            none.cast(profile).alias("schema"), none.cast("array<array<string>>").alias("sample_rows"),
            F.array(F.lit("h")).alias("header"))).alias("analysis"))


@register("report_roundtrip", STAR_SQL + f""",
f as (select file_id, coalesce(list(code || ':' || count || ':' || case when code in ({', '.join("'" + c + "'" for c in dims.HIGH_IMPACT_CODES)}) then '1' else '0' end order by code), []) as l
      from found group by file_id)
select substr(sha1(url || '?' || raw.file_id), 1, 16) as id, coalesce(array_to_string(l, ','), '') as issues from raw left join f using (file_id)""")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report written as index and detail, read back, and put together again."""
    target = scratch(spark, "report")
    RP.write_report(nested_results(spark, sf_dir), target)
    full = RP.rebuild(RP.read_report(spark, target), RP.read_details(spark, target))
    text = F.transform("analysis.issues", lambda i: F.concat_ws(
        ":", i["code"], i["count"], F.when(i["columns"].isNotNull(), "1").otherwise("0")))
    return full.select("id", F.coalesce(F.array_join(text, ","), F.lit("")).alias("issues"))


@register("checkpoint_roundtrip", STAR_SQL + """
select url || '?' || file_id as url, format, size_bytes as size from raw where format <> 'WMS'""")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as a checkpoint without the service files, then read back."""
    target = scratch(spark, "checkpoint")
    results = nested_results(spark, sf_dir)
    rows = results.select("url", F.struct(*results.columns).alias("result"))
    RP.write_checkpoint(rows, target, rows.filter("result.format = 'WMS'").select("url"))
    back = RP.read_checkpoint(spark, target)
    return back.select("url", "result.format", F.col("result.fetch.size").alias("size"))


@register("audits_by_format", """
select page_id, case page_id % 3 when 0 then 'JSON' when 1 then 'TXT' else 'BIN' end as format,
  case page_id % 3 when 0 then 'json-invalido' when 1 then null else 'no-es-archivo' end as code from pages""")
def audits_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages declared as three formats, each through its own audit."""
    docs = table(spark, sf_dir, "pages").select(
        "page_id", F.expr("case page_id % 3 when 0 then 'JSON' when 1 then 'TXT' else 'BIN' end").alias("format"), F.col("html").alias("text"))
    audits = {
        "JSON": lambda d: DO.json_outcome(d).select("page_id", "format", "code"),
        "TXT": lambda d: d.select("page_id", "format", F.when(F.trim("text") == "", "sin-contenido").alias("code")),
    }

    def other(d: DataFrame) -> DataFrame:
        found = SN.type_conformance(F.col("format"), SN.detected_type(F.col("text")))
        return d.select("page_id", "format", found["code"].alias("code"))

    return DO.audit_by_format(docs, audits, other)


@register("arrivals_stream", """
select page_id, cast(octet_length(encode(html)) as bigint) as size_bytes, 'html' as kind, 'no-es-archivo' as code from pages""")
def arrivals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they arrive, audited by a stream into a results table."""
    source = table(spark, sf_dir, "pages")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/pages.parquet*")
    target, state = scratch(spark, "arrivals"), scratch(spark, "arrivals-state")
    arrivals.audit_stream(
        stream, lambda b: arrivals.audit_payloads(b.select("page_id", F.col("html").alias("content"))), "page_id", target, state)
    return spark.read.parquet(target).select("page_id", "size_bytes", "kind", "code")


@register("search_documents", """
select doc_id from documents where contains(strip_accents(lower(text)), 'eaux') and contains(strip_accents(lower(text)), 'ere')""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(T.matches_query(F.col("text"), "ÈRE éaux")).select("doc_id")


@register("empty_payloads", "select page_id, page_id % 8 = 4 as empty from pages")
def empty_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which payloads hold nothing at all."""
    return arrivals.audit_payloads(payloads(spark, sf_dir)).select("page_id", "empty")


# --- one collection of all formats ----------------------------------------------------
# A complete archive without members, as bytes in hex digits.
_ZIP = "504B0304" + "00" * 26 + "504B0506" + "00" * 18
CSV_LINE = ("concat_ws(';', cast(s_suppkey as string), if(s_suppkey % 7 = 0, 'N/D', cast(cast(s_acctbal as bigint) as string)), "
            "if(s_suppkey % 5 = 0, null, s_name))")
TXT_DOC = """case p_partkey % 3 when 0 then concat(p_brand, '\n \n', p_type) when 1 then concat('a|b\n', p_size, '|x\n', p_size, '|y\n', if(p_partkey % 2 = 0, '7', '7|z|w'))
  else ' \n\n' end"""


def collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of all formats side by side, and the members of the packages among them."""
    def files(source: DataFrame, prefix: str, key: str, kind: F.Column, content: F.Column) -> DataFrame:
        return source.select(F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string")).alias("file_id"), kind.alias("format"), content.alias("content"))

    def tab(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    # One table per nation, in three encodings; as many rows as a nation has suppliers.
    lines = tab("supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", F.expr(CSV_LINE).alias("line")))).alias("l"))
    text = F.concat(F.lit("k;v;w\n"), F.array_join(F.transform("l", lambda e: e["line"]), "\n"), F.lit("\n"))
    coded = F.when(F.col("s_nationkey") % 3 == 0, F.encode(text, "UTF-16")).when(
        F.col("s_nationkey") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).otherwise(text.cast("binary"))
    events, bodies = tab("events"), payloads(spark, sf_dir)
    service = "if(s_suppkey % 2 = 0, 'WMS', 'WFS')"
    parts = [
        files(lines, "csv", "s_nationkey", F.lit("CSV"), coded),
        files(tab("part"), "txt", "p_partkey", F.lit("TXT"), F.expr(TXT_DOC).cast("binary")),
        files(events, "json", "event_id", F.lit("JSON"), F.expr(JSON_DOC).cast("binary")),
        files(events, "geo", "event_id", F.lit("GeoJSON"), F.expr(GEOJSON).cast("binary")),
        files(tab("orders"), "xml", "o_orderkey", F.expr(KINDS), F.expr(XML_DOC).cast("binary")),
        files(tab("supplier"), "ogc", "s_suppkey", F.expr(service), F.expr(SERVICE_DOC).cast("binary")),
        files(tab("customer"), "ical", "c_custkey", F.lit("iCal"), F.expr(CALENDAR_DOC).cast("binary")),
        files(bodies, "bin", "page_id", F.expr("element_at(array('BIN','JPEG','ECW','XLSX','SHP','OTRO'), cast(page_id % 6 + 1 as int))"), F.col("content")),
        files(tab("lineitem").select("l_orderkey").distinct(), "shp", "l_orderkey", F.lit("SHP"), F.unhex(F.lit(_ZIP))),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    members = tab("lineitem").select(
        F.concat(F.lit("shp/"), F.col("l_orderkey").cast("string")).alias("archive_id"), F.expr(MEMBER.format(s="string")).alias("name"),
        F.expr("cast(round(l_extendedprice * 10000) as bigint)").alias("size"), F.expr("cast(l_orderkey % 9 * 3000000 as bigint)").alias("zip_size"))
    return whole, members


@register("mixed_collection", f"""
with csv as (
  select s_nationkey as k, count(*) as n, count(*) filter (where s_suppkey % 7 = 0) as words, count(*) filter (where s_suppkey % 5 = 0) as short
  from supplier group by 1),
csv_codes as (select *, words > 0 and n >= 3 and n - words > words as typed from csv),
shp as (
  select *, list_sort(list_filter(list_concat([code, case when not has_projection then 'sin-prj' end],
    list_transform(list_filter(string_split(missing_parts, ','), lambda p: p not in ('', '.shp')), lambda p: 'componente-faltante-' || substr(p, 2))),
    lambda x: x is not null)) as codes from ({{manifests}})),
body as (
  select page_id, (['BIN','JPEG','ECW','XLSX','SHP','OTRO'])[page_id % 6 + 1] as format, page_id % 8 as b, length(url) >= 18 as cut from pages),
judged as (
  select *, case when b = 4 then 'archivo-vacio'
     when format in ('BIN', 'OTRO') then case when b = 0 then 'no-es-archivo' when b in (1, 2, 3) then 'tipo-detectado' else 'tipo-no-identificado' end
     when format in ('JPEG', 'ECW') then case when b = 0 then 'no-es-imagen' else 'firma-invalida' end
     when format = 'XLSX' then case when b <> 3 or cut then 'xlsx-invalido' end
     else case when b = 0 then 'no-es-archivo' when b <> 3 then 'zip-invalido' when cut then 'descarga-truncada' end end as code from body)
select file_id, format, cast(score as int) as score, codes, cast(entities as bigint) as entities from (
select 'csv/' || k as file_id, 'CSV' as format, 100 - 15 * typed::int - 5 * (short > 0)::int as score,
  array_to_string(list_filter([case when short > 0 then 'celda-faltante' end, case when typed then 'error-tipo' end], lambda x: x is not null), ',') as codes,
  n as entities from csv_codes
union all select 'txt/' || p_partkey, 'TXT', case p_partkey % 3 when 2 then 0 when 0 then 100 else case when p_partkey % 2 = 0 then 95 else 85 end end,
  case p_partkey % 3 when 2 then 'sin-contenido' when 0 then '' else case when p_partkey % 2 = 0 then 'celda-faltante' else 'celda-extra' end end,
  case p_partkey % 3 when 2 then 0 when 0 then 2 else 3 end from part
union all select 'json/' || event_id, 'JSON', case when event_id % 5 in (0, 2) then 95 else 100 end,
  case when event_id % 5 in (0, 2) then 'celda-faltante' else '' end, case when event_id % 5 = 0 then 3 else 2 end from events
union all select 'geo/' || event_id, 'GeoJSON', score, coalesce(code, ''), features from ({{geojson_features}})
union all select 'xml/' || file_id, kind, score, coalesce(code, ''), coalesce(entities, total_elements) from ({{xml_inventory}})
union all select 'ogc/' || file_id, service, score, coalesce(code, ''), offered from ({{service_inventory}})
union all select 'ical/' || file_id, 'iCal', score, codes, events from ({{calendars}})
union all select 'shp/' || archive_id, 'SHP', case when code is not null then 0 else 100 - 5 * len(codes) end, array_to_string(codes, ','), null from shp
union all select 'bin/' || page_id, format, case when b = 4 or code is null or code = 'descarga-truncada' then null when code = 'tipo-detectado' then 80 else 0 end,
  coalesce(code, ''), null from judged)""".format(**SQL))
def mixed_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in three encodings, JSON, GeoJSON, XML, services, calendars, packages, images and unknown files in one audit."""
    files, members = collection(spark, sf_dir)
    return CO.audit_collection(files, members).select("file_id", "format", "score", F.array_join("codes", ",").alias("codes"), "entities")


@register("wide_profiles", """
with r as (select s_nationkey as k, s_suppkey as i, s_suppkey % 4 as surplus from supplier),
w as (select k, count(*) as n, max(surplus) as widest from r group by 1),
c as (select w.k, w.n, t.c from w, unnest(range(0, 1 + widest)) as t(c))
select c.k as file_id, cast(c.c as int) as col, case when c.c = 0 then 'k' else 'Col ' || (c.c + 1) end as name,
  cast(c.n - count(r.i) filter (where r.surplus >= c.c) as bigint) as null_count, count(distinct case when c.c = 0 then r.i else r.i % 10 end)
  filter (where r.surplus >= c.c) as "distinct" from c join r using (k) group by c.k, c.c, c.n""")
def wide_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of tables whose rows run beyond a header of one column, one table per nation."""
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("file_id"), F.lit("").alias("sheet"), (F.col("s_suppkey") + 1).alias("row_no"),
        F.expr("concat(array(cast(s_suppkey as string)), array_repeat(cast(s_suppkey % 10 as string), cast(s_suppkey % 4 as int)))").alias("tokens"),
        F.array(F.lit("k")).alias("header"))
    headers = rows.select("file_id", "sheet", "header").distinct()
    return DF.audit_rows(rows, headers)["profiles"].select("file_id", "col", "name", "null_count", "distinct")


@register("native_cells", """
select event_id, coalesce(case when event_id % 3 > 0 then cast(user_id as varchar) end, '') as number,
  coalesce(case when event_id % 5 > 0 then case when event_id % 2 = 0 then 'true' else 'false' end end, '') as flag,
  case when event_id % 7 > 0 then '{"u":' || user_id || ',"t":["' || event_type || '"]}' else '' end as nested from events""")
def native_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native values of events as the text of a cell: numbers, booleans and nested values, some of them null."""
    nested = F.when(F.col("event_id") % 7 > 0, F.struct(F.col("user_id").alias("u"), F.array("event_type").alias("t")))
    return table(spark, sf_dir, "events").select(
        "event_id", cell_text(F.when(F.col("event_id") % 3 > 0, F.col("user_id"))).alias("number"),
        cell_text(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 2 == 0)).alias("flag"), cell_text(nested, "nested").alias("nested"))
