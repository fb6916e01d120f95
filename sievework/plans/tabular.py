"""Table audits over the driver tables rendered as text cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import cells as C
from sievework.functions import issues as I
from sievework.functions.encoding import detect_encoding
from sievework.functions.numbers import round_half_up
from sievework.functions.text import contains_text
from sievework.operators import defects as DF
from sievework.operators import issues as IO
from sievework.operators import profile as P
from sievework.plans.report import half_up
from sievework.plans.star import table
from sievework.session import checkpoint_dir, written_table
from sievework.sources import delimited as DL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- dirty text columns over orders, the same text in both engines ----------
DIRTY = {
    "key": "cast(o_orderkey as {s})",
    "total": "case when o_orderkey % 97 = 3 then 'N/D' when o_orderkey % 53 = 4 then '' "
             "when o_orderkey % 5 = 1 then replace(cast(cast(o_totalprice as decimal(18,2)) as {s}), '.', ',') "
             "else cast(cast(o_totalprice as decimal(18,2)) as {s}) end",
    "day": "case when o_orderkey % 101 = 5 then concat('1/', cast(o_orderkey % 12 + 1 as {s}), '/1999') "
           "when o_orderkey % 31 = 6 then ' ' else substr(cast(o_orderdate as {s}), 1, 10) end",
    "flag": "case o_orderkey % 4 when 0 then 'true' when 1 then ' FALSE ' when 2 then 'False' else 'sí' end",
    "priority": "o_orderpriority",
    "sparse": "case when o_orderkey % 3 = 0 then cast(o_custkey as {s}) end",
}


def dirty_columns(spark_side: bool) -> dict[str, str]:
    return {k: v.format(s="string" if spark_side else "varchar") for k, v in DIRTY.items()}


def orders_cells(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    columns = {k: F.expr(v) for k, v in dirty_columns(True).items()}
    row_no = (F.col("o_orderkey") + 2) if positions else None
    return P.table_cells(table(spark, sf_dir, "orders"), columns, row_no, file_id="orders")


def cells_sql(columns: dict[str, str], source: str, row_no: str, file_id: str = "'table'", sheet: str = "''") -> str:
    return "cells as (" + " union all ".join(
        f"select {file_id} as file_id, {sheet} as sheet, {i} as col, '{name}' as field, {row_no} as row_no, "
        f"{expr} as raw from {source}" for i, (name, expr) in enumerate(columns.items())) + ")"


NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COMMA_RE = r"^[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+),[0-9]+$"
TYPED_SQL = f"""
typed as (
  select *, case when raw is null or trim(raw) = '' then 'empty'
                 when lower(trim(raw)) in ('true','false') then 'bool'
                 when regexp_matches(trim(raw), '{NUMBER_RE}') or regexp_matches(trim(raw), '{COMMA_RE}') then 'number'
                 when regexp_matches(trim(raw), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
                      and try_strptime(trim(raw), '%Y-%m-%d') is not null then 'date'
                 else 'str' end as kind from cells),
vals as (
  select *, case when kind = 'number' then try_cast(case when regexp_matches(trim(raw), '{COMMA_RE}')
                   then replace(replace(trim(raw), '.', ''), ',', '.') else trim(raw) end as double) end as num,
         case when kind in ('date', 'str') then cast(try_strptime(trim(raw), ['%Y-%m-%d','%d/%m/%Y','%d-%m-%Y','%d/%m/%y','%Y/%m/%d']) as date) end as day
  from typed),
st as (
  select file_id, sheet, col, min(field) as field, count(*) as present,
         count(*) filter (where kind = 'number') as n_number, count(*) filter (where kind = 'date') as n_date,
         count(*) filter (where kind = 'bool') as n_bool, count(*) filter (where kind = 'str') as n_str,
         count(*) filter (where kind = 'empty') as n_empty, count(*) filter (where kind <> 'empty') as filled,
         count(distinct case when kind <> 'empty' then raw end) as distinct_n,
         min(num) as min_num, max(num) as max_num, min(day) as min_day, max(day) as max_day
  from vals group by file_id, sheet, col),
rk as (
  select file_id, sheet, col, kind, n, row_number() over (partition by file_id, sheet, col order by n desc, pr) as r
  from (select file_id, sheet, col, 'number' as kind, n_number as n, 0 as pr from st union all
        select file_id, sheet, col, 'date', n_date, 1 from st union all
        select file_id, sheet, col, 'bool', n_bool, 2 from st union all
        select file_id, sheet, col, 'str', n_str, 3 from st)),
stats as (
  select st.*, case when filled = 0 then 'empty' else a.kind end as majority, a.n as majority_n, b.n as second_n
  from st join rk a on a.file_id = st.file_id and a.sheet = st.sheet and a.col = st.col and a.r = 1
          join rk b on b.file_id = st.file_id and b.sheet = st.sheet and b.col = st.col and b.r = 2)"""
FIND_SQL = TYPED_SQL + """,
cellfind as (
  select v.file_id, case when kind = 'empty' then 'celda-faltante' else 'error-tipo' end as code, v.sheet, v.col,
         v.field, v.row_no, case when kind <> 'empty' then raw end as cell
  from vals v join stats s using (file_id, sheet, col)
  where (kind = 'empty' and filled * 1.0 / (filled + n_empty) >= 0.5)
     or (kind not in ('empty') and kind <> majority and filled >= 3 and majority in ('number','date','bool')
         and majority_n > second_n))"""
PROFILE_SELECT = f"""
select file_id, sheet, col, field as name,
       case majority when 'number' then 'number' when 'date' then 'date' when 'bool' then 'boolean' else 'string' end as type,
       n_empty as null_count, {half_up('n_empty * 1.0::double / present', 4)} as null_pct, distinct_n as "distinct",
       case when majority = 'number' then min_num end as min_num, case when majority = 'number' then max_num end as max_num,
       case when majority = 'date' then min_day end as min_date, case when majority = 'date' then max_day end as max_date
from stats"""

LINEITEM_TEXT = {
    c: (f"cast(cast({c} as decimal(18,2)) as varchar)"
        if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        else f"strftime({c}, '%Y-%m-%d')" if c == "l_shipdate" else f"cast({c} as varchar)")
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
}
ORDERS_CELLS = "with " + cells_sql(dirty_columns(False), "orders", "o_orderkey + 2", "'orders'")


@register("column_profile", "with " + cells_sql(LINEITEM_TEXT, "lineitem", "0") + "," + TYPED_SQL + PROFILE_SELECT)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile_table(table(spark, sf_dir, "lineitem"))


@register("dirty_profile", ORDERS_CELLS + "," + TYPED_SQL + PROFILE_SELECT)
def dirty_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_profiles(P.column_stats(P.value_counts(orders_cells(spark, sf_dir, positions=False))))


@register("type_counts", ORDERS_CELLS + "," + TYPED_SQL + """
select file_id, sheet, col, field, n_number, n_date, n_bool, n_str, n_empty, majority, majority_n, second_n from stats""")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_stats(P.value_counts(orders_cells(spark, sf_dir, positions=False))).select(
        "file_id", "sheet", "col", "field", "n_number", "n_date", "n_bool", "n_str", "n_empty",
        "majority", "majority_n", "second_n")


@register("null_share", ORDERS_CELLS + "," + TYPED_SQL + f"""
select file_id, sheet, floor(avg({half_up('n_empty * 1.0::double / present', 4)}) * 1000000.0 + 0.5) / 1000000.0 as avg_null_pct from stats group by file_id, sheet""")
def null_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = P.schema_null_pct(dirty_profile(spark, sf_dir))
    return shares.withColumn("avg_null_pct", round_half_up(F.col("avg_null_pct"), 6))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = orders_cells(spark, sf_dir)
    stats = P.column_stats(P.value_counts(orders_cells(spark, sf_dir, positions=False)))
    return DF.cell_defects(cells, stats, columns=len(DIRTY))


@register("type_errors", ORDERS_CELLS + "," + FIND_SQL + """
select file_id, col, field, row_no, cell from cellfind where code = 'error-tipo'""")
def type_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).filter("code = 'error-tipo'").select("file_id", "col", "field", "row_no", "cell")


@register("missing_cells", ORDERS_CELLS + "," + FIND_SQL + """
select file_id, col, field, row_no from cellfind where code = 'celda-faltante'""")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).filter("code = 'celda-faltante'").select("file_id", "col", "field", "row_no")


BOOK_CELLS = "with " + cells_sql(
    {k: v for k, v in dirty_columns(False).items() if k != "key"}, "orders", "o_orderkey + 2",
    "'book' || (o_custkey % 20)", "o_orderpriority")


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(i).alias("col"), F.lit(n).alias("field"), F.expr(e).alias("raw"))
        for i, (n, e) in enumerate((n, e) for n, e in dirty_columns(True).items() if n != "key")])
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("book"), (F.col("o_custkey") % 20).cast("string")).alias("file_id"),
        F.col("o_orderpriority").alias("sheet"), (F.col("o_orderkey") + 2).alias("row_no"), F.inline(entries))


@register("workbook_findings", BOOK_CELLS + "," + FIND_SQL + """
select file_id, sheet, code, col, count(*) as cases, min(row_no) as first_row, max(row_no) as last_row
from cellfind group by file_id, sheet, code, col""")
def workbook_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet of every workbook judged on its own."""
    findings = DF.audit_cells(workbook_cells(spark, sf_dir))["findings"]
    return findings.groupBy("file_id", "sheet", "code", "col").agg(
        F.count(F.lit(1)).alias("cases"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@register("workbook_files", BOOK_CELLS + "," + FIND_SQL + """,
i as (select file_id, code, count(*) as n from cellfind group by file_id, code),
s as (select file_id, count(*) filter (where code = 'error-tipo') as ek, count(*) filter (where code = 'celda-faltante') as wk,
             coalesce(sum(n) filter (where code = 'error-tipo'), 0) as ec, cast(sum(n) as bigint) as error_cells from i group by file_id),
r as (select file_id, count(distinct row_no) as rows, count(distinct sheet) as sheets from cells group by file_id)
select r.*, coalesce(error_cells, 0) as error_cells,
       cast(100 - least(60, 15 * coalesce(ek, 0)) - 5 * coalesce(wk, 0) - case when ec > 1000 then 10 else 0 end as int) as score,
       coalesce(ec, 0) = 0 as ok from r left join s using (file_id)""")
def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DF.audit_cells(workbook_cells(spark, sf_dir))["files"].select(
        "file_id", "rows", "sheets", "error_cells", "score", "ok")


@register("duplicate_rows", """
select doc_id from (select doc_id, row_number() over (partition by text, lang order by doc_id) as k from documents) where k > 1""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return DF.duplicate_rows(docs, [F.col("text"), F.col("lang")], "doc_id").select("doc_id")


@register("unique_violations", """
select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k
from orders) where k > 1""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return DF.unique_violations(orders, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey")


@register("constraint_violations", """
select o_orderkey, 'total' as rule from orders where not (o_totalprice between 1000 and 400000)
union all select o_orderkey, 'status' from orders where not (o_orderstatus in ('O', 'F'))""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"total": F.col("o_totalprice").between(1000, 400000), "status": F.col("o_orderstatus").isin("O", "F")}
    return DF.constraint_violations(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), rules
    ).select("o_orderkey", "rule")


@register("occurrences_roundtrip", ORDERS_CELLS + "," + FIND_SQL + """
select code, col, field, row_no, cell from cellfind""")
def occurrences_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings packed into delta-coded chunks and unpacked again."""
    packed = IO.compact_occurrences(located(spark, sf_dir))
    return IO.expand_occurrences(packed).select("code", "col", "field", "row_no", "cell")


@register("compact_occurrences", ORDERS_CELLS + "," + FIND_SQL + """
select code, col, cast(row_no // 100000 as bigint) as chunk, count(*) as n, min(row_no) as first_delta,
       max(row_no) - min(row_no) as rest
from cellfind group by code, col, row_no // 100000""")
def compact_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk summaries: length, absolute start, and the sum of the other deltas."""
    packed = IO.compact_occurrences(located(spark, sf_dir))
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, d: a + d)
    return packed.select("code", "col", "chunk", F.size("rows").cast("bigint").alias("n"),
                         F.get("rows", F.lit(0)).alias("first_delta"),
                         (total - F.get("rows", F.lit(0))).alias("rest"))


@register("stored_occurrences", ORDERS_CELLS + "," + FIND_SQL + """,
n as (select *, row_number() over (partition by file_id, code order by sheet, col, row_no) as n from cellfind)
select code, count(*) as count, count(*) filter (where n <= 200) as stored, count(*) > 200 as truncated from n group by code""")
def stored_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located occurrences kept per issue under a cap, beside the true count."""
    found = located(spark, sf_dir)
    stored = IO.cap_occurrences(found, 200).groupBy("code").agg(F.count(F.lit(1)).alias("stored"))
    counts = found.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(stored, "code").select(
        "code", "count", "stored", I.is_truncated(F.col("stored"), F.col("count")).alias("truncated"))


@register("occurrence_page", ORDERS_CELLS + "," + FIND_SQL + """
select sheet, col, field, row_no, cell from cellfind where code = 'error-tipo' order by sheet, col, row_no limit 50 offset 25""")
def occurrence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.positions(located(spark, sf_dir), "orders", "error-tipo", offset=25, limit=50).select(
        "sheet", "col", "field", "row_no", "cell")


@register("affected_columns", ORDERS_CELLS + "," + FIND_SQL + """
select code, col, field, count(*) as cases from cellfind group by code, col, field""")
def affected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.affected_columns(located(spark, sf_dir)).select("code", "col", "field", "cases").orderBy(
        F.desc("cases"), "code", "col")


@register("table_issues", ORDERS_CELLS + "," + FIND_SQL + """
select file_id, code, count(*) as count, case code when 'celda-faltante' then 'warning' else 'error' end as severity
from cellfind group by file_id, code""")
def table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.from_occurrences(located(spark, sf_dir)).select("file_id", "code", "count", "severity")


@register("merged_issues", ORDERS_CELLS + "," + FIND_SQL + """,
u as (select file_id, code, count(*) as count, case code when 'celda-faltante' then 'warning' else 'error' end as severity
      from cellfind group by file_id, code
      union all select 'orders', 'celda-faltante', count(*), 'error' from orders where o_orderstatus = 'P')
select file_id, code, cast(sum(count) as bigint) as count,
       case when bool_or(severity = 'error') then 'error' else 'warning' end as severity from u group by file_id, code""")
def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two checks under one code: counts add up, error wins."""
    other = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("orders").alias("file_id"), F.lit("celda-faltante").alias("code"), "count", F.lit("error").alias("severity"))
    return IO.merge_issues(table_issues(spark, sf_dir).unionByName(other)).select("file_id", "code", "count", "severity")


@register("search_rows", """
select o_orderkey from orders where contains(lower(concat_ws(chr(1), cast(o_orderkey as varchar), cast(o_custkey as varchar),
  o_orderstatus, o_orderpriority)), '3-med')""")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cells = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return orders.filter(contains_text("3-MED", *cells)).select("o_orderkey")


@register("cell_values", """
with c as (select event_id, case event_id % 8 when 0 then replace(cast(cast(value as decimal(18,2)) as varchar), '.', ',')
    when 1 then ' ' || cast(cast(value as decimal(18,2)) as varchar) when 2 then strftime(ts, '%d/%m/%Y')
    when 3 then strftime(ts, '%Y-%m-%d') when 4 then strftime(ts, '%d-%m-%Y') when 5 then strftime(ts, '%d/%m/%y')
    when 6 then strftime(ts, '%Y/%m/%d') else event_type end as raw from events)
select event_id, case when regexp_matches(trim(raw), '""" + COMMA_RE + """') or regexp_matches(trim(raw), '""" + NUMBER_RE + """') then 'number'
    when event_id % 8 = 3 then 'date' else 'str' end as kind,
  try_cast(replace(trim(raw), ',', '.') as double) as num,
  cast(case when event_id % 8 = 5 then try_strptime(raw, '%d/%m/%y')
       else try_strptime(raw, ['%Y-%m-%d','%d/%m/%Y','%d-%m-%Y','%Y/%m/%d']) end as date) as day from c""")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing, number and date parsing of mixed spellings."""
    raw = F.expr("""case event_id % 8 when 0 then replace(cast(cast(value as decimal(18,2)) as string), '.', ',')
        when 1 then ' ' || cast(cast(value as decimal(18,2)) as string) when 2 then date_format(ts, 'dd/MM/yyyy')
        when 3 then date_format(ts, 'yyyy-MM-dd') when 4 then date_format(ts, 'dd-MM-yyyy')
        when 5 then date_format(ts, 'dd/MM/yy') when 6 then date_format(ts, 'yyyy/MM/dd') else event_type end""")
    return table(spark, sf_dir, "events").withColumn("raw", raw).select(
        "event_id", C.value_type(F.col("raw")).alias("kind"), C.to_number(F.col("raw")).alias("num"),
        C.parse_date(F.col("raw")).alias("day"))


# --- raw text written by Spark from the tables ------------------------------
HEADER = "key;cust;total;;status;KEY"
LINE = (
    "case when o_orderkey % 50 = 7 then '   ' when o_orderkey % 41 = 3 then concat(cast(o_orderkey as {s}), ';', cast(o_custkey as {s})) "
          "when o_orderkey % 37 = 2 then concat(cast(o_orderkey as {s}), ';1;2;3;4;5;extra;more') "
          "else concat(cast(o_orderkey as {s}), ';', cast(o_custkey as {s}), ';', case when o_orderkey % 29 = 1 then 'N/D' "
          "else cast(cast(o_totalprice as decimal(18,2)) as {s}) end, ';\"a;\"\"b\"\"\";', o_orderstatus, ';', cast(o_orderkey % 9 as {s})) end"
)


def write_delimited(spark: SparkSession, sf_dir: str) -> str:
    """Orders as defective delimited files in the shared folder; returns the path."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/delimited-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "orders").select(F.expr(LINE.format(s="string")).alias(HEADER))
    # One column, no quoting: the column name becomes the first line of each file.
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").option(
        "emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(target)
    return target


@register("physical_rows", f"""
with l as (select o_orderkey, {LINE.format(s='varchar')} as v from orders)
select 'celda-faltante' as code, count(*) * 4 as cases from l where o_orderkey % 41 = 3 and trim(v) <> ''
union all select 'celda-extra', 2 * count(*) from l where v like '%;extra;more'
union all select 'fila-vacia', count(*) from l where trim(v) = ''
union all select 'error-tipo', count(*) from l where v like '%N/D%'
union all select 'rows', count(*) from l""")
def physical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in delimited text read back with physical row numbers.

    Header findings depend on how many files were written, so they are left
    to the tests; ``rows`` counts distinct (file, row) pairs.
    """
    rows, headers = DL.read_delimited(spark, write_delimited(spark, sf_dir))
    rows = written_table(rows, "rows")
    audit = DF.audit_rows(rows, headers)
    cases = audit["findings"].filter(
        "code in ('celda-extra', 'fila-vacia', 'error-tipo') or (code = 'celda-faltante' and row_no > 1)"
    ).groupBy("code").agg(F.count(F.lit(1)).alias("cases"))
    counted = rows.select("file_id", "row_no").distinct().agg(F.count(F.lit(1)).alias("cases")).select(
        F.lit("rows").alias("code"), "cases")
    return cases.unionByName(counted)


# Stored encodings of the files of ``wide_rows`` by remainder, with the writer's names for them.
WIDE_FILES = (("utf_16_le", "UTF-16LE"), ("utf_16_be", "UTF-16BE"), ("utf_32_be", "UTF-32"))


@register("wide_rows", """
select doc_id, case doc_id % 3 when 0 then 'utf_16_le' when 1 then 'utf_16_be' else 'utf_32_be' end as encoding,
  3 as cells, md5(regexp_replace(coalesce(text, ''), '[\\x0A\\x0D]', ' ', 'g')) as digest from documents""")
def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line of a marked UTF-16 or UTF-32 file, found by the mark and read back by line."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/wide-{uuid.uuid4().hex}"
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(";", F.col("doc_id").cast("string"), quoted, F.lit("end")).alias("\ufeffdoc_id;text;end"))
    for rest, (name, charset) in enumerate(WIDE_FILES):
        lines.filter(F.col("doc_id") % 3 == rest).drop("doc_id").write.option("header", True).option("encoding", charset).option(
            "sep", "\u0001").option("quote", "\u0000").option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{target}/{name}")
    rows, headers = DL.read_delimited(spark, [f"{target}/{name}" for name, _ in WIDE_FILES])
    known = rows.join(headers.select("file_id", "encoding"), "file_id")
    return known.select(
        F.get("tokens", F.lit(0)).cast("bigint").alias("doc_id"), "encoding", F.size("tokens").alias("cells"),
        F.md5(F.get("tokens", F.lit(1)).cast("binary")).alias("digest"))


@register("text_scan", """
select doc_id, cast(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as bigint) as lines from documents""")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document, counted over whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    filled = F.size(F.filter("parts", lambda x: ~C.is_blank(x)))
    return docs.select("doc_id", filled.cast("bigint").alias("lines"))


@register("encodings", """
select doc_id, case when doc_id % 3 = 2 and regexp_matches(text, '[^\\x00-\\x7F]') and not regexp_matches(text, '[^\\x00-\\xFF]')
  then 'cp1252' else 'utf-8' end as encoding
from documents""")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of each document's bytes; every third that can be is stored as ISO-8859-1, the others as UTF-8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    single = (F.col("doc_id") % 3 == 2) & ~F.col("text").rlike("[^\\x00-\\xFF]")
    content = F.when(single, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", detect_encoding(content).alias("encoding"))


@register("quoted_records", """
select doc_id, md5(replace(text, chr(13), chr(10))) as digest, cast(len(text) - len(replace(text, chr(10), '')) as int) as breaks from documents""")
def quoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as quoted cells with line breaks and read back whole."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/quoted-{uuid.uuid4().hex}"
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(";", F.col("doc_id").cast("string"), quoted).alias("value"))
    docs.write.text(target)
    records = DL.read_records(spark, target)
    text = F.get("tokens", F.lit(1))
    return records.select(
        F.get("tokens", F.lit(0)).cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"))


@register("issue_detail", ORDERS_CELLS + "," + FIND_SQL + """,
pc as (select file_id, code, col, field, count(*) as n from cellfind group by all)
select file_id, code, case code when 'celda-faltante' then 'warning' else 'error' end as severity, cast(sum(n) as bigint) as count,
       cast(sum(n) as bigint) as positions, string_agg(field || ':' || n, ',' order by n desc, col) as columns
from pc group by file_id, code""")
def issue_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = located(spark, sf_dir)
    detail = IO.issue_detail(IO.from_occurrences(found), found)
    listed = F.transform("columns", lambda c: F.concat_ws(":", c["field"], c["cases"]))
    return detail.select("file_id", "code", "severity", "count", "positions", F.array_join(listed, ",").alias("columns"))


@register("sample_rows", """
select o_orderkey + 2 as row_no, cast(o_orderkey as varchar) || '|' || substr(repeat(o_orderpriority, 300), 1, 1000) as tokens
from orders where o_orderkey + 2 <= 201""")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two hundred data rows by position, cells clipped."""
    rows = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("file_id"), (F.col("o_orderkey") + 2).alias("row_no"),
        F.array(F.col("o_orderkey").cast("string"), F.repeat("o_orderpriority", F.lit(300))).alias("tokens"))
    return P.sample_rows(rows).select("row_no", F.array_join("tokens", "|").alias("tokens"))


@register("header_findings", f"""
with labels as (
  select cast(doc_id as varchar) as file_id, unnest(header) as label, cast(generate_subscripts(header, 1) - 1 as int) as col
  from (select doc_id, string_split(split_part(text, chr(10), 1), ' ') as header from documents)),
named as (select *, lower(trim(label, '{C.WHITESPACE}')) as name from labels),
numbered as (select *, row_number() over (partition by file_id, name order by col) as k from named)
select file_id, 'encabezado-vacio' as code, col, label as field from numbered where name = '' or regexp_full_match(label, 'Columna [0-9]+')
union all
select file_id, 'encabezado-duplicado', col, label from numbered where name <> '' and k > 1""")
def header_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every document as the labels of a table: those that are blank and those that repeat."""
    first = F.split(F.substring_index("text", "\n", 1), " ")
    headers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.lit("").alias("sheet"), first.alias("header"))
    found = DF.blank_labels(headers).unionByName(DF.duplicate_labels(headers))
    return found.select("file_id", "code", F.col("col").cast("int").alias("col"), "field")


@register("text_files", """
select lang, cast(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) as bigint) as lines, true as readable
from documents group by lang""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as plain text files, counted line by line."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(target)
    scan = DL.scan_text(DL.read_lines(spark, target))
    lang = F.regexp_extract("file_id", "lang=([^/]+)/", 1)
    return scan.groupBy(lang.alias("lang")).agg(F.sum("lines").alias("lines"), F.bool_and(F.col("score") > 0).alias("readable"))
