"""One mixed collection of files, each through the audit of its format.

The collection is read once and kept by the audits that answer for a file, so
no file passes the expressions of another format.  Every format's audit is an
expression over the file's row that fills a verdict for its own formats and
sees null text for all others; audits of the same formats follow each other in
one projection and need no exchange.  Tables (delimited files, and the records
of JSON documents) are the exception: their lines leave the file's row, all
tables share one aggregation over their cells, and the scores come back by file.

The registry is the extension point: ``AUDITS`` lists audits with the formats
they answer for; one that comes later is asked for the formats it names.

Binary containers are judged by their signature and, where given, by their
long form: ``members`` of packages and ``cells`` of workbooks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import sniff as SN
from sievework.functions.encoding import decode_text
from sievework.functions.json_text import computed
from sievework.operators import defects as DF
from sievework.operators import documents as DO
from sievework.operators.groups import spread
from sievework.session import checkpoint_dir, written_table
from sievework.sources.delimited import guess_delimiter, split_cells

XML_FORMATS, SERVICES = ("XML", "RDF", "RSS", "KML", "GML"), ("WMS", "WFS")
DELIMITED, IMAGES, UNTYPED = ("CSV", "TXT"), ("JPEG", "ECW"), ("BIN", "OTRO")
TEXT_FORMATS = (*XML_FORMATS, *SERVICES, *DELIMITED, "JSON", "GeoJSON", "iCal")


def _codes(*codes: Column) -> Column:
    return F.array_compact(F.array(*[c.cast("string") for c in codes]))


def _verdict(score: Column, codes: Column, n: Column | None = None) -> Column:
    """Score (null: not measured), codes of what was found, and how many entities the file holds."""
    return F.struct(score.cast("int").alias("score"), codes.alias("codes"), (F.lit(None) if n is None else n).cast("bigint").alias("entities"))


class Audit(NamedTuple):
    formats: tuple[str, ...]
    #: From files with ``text`` (null where another audit answers) to the same rows with a column ``found``, a verdict.
    run: Callable[[DataFrame], DataFrame]


def _markup(files: DataFrame) -> DataFrame:
    """XML documents and stored answers of services: one scan of the tags serves both."""
    scanned = computed(DO.xml_inventory(files, "text"), {"entities": F.when(F.col("well_formed"), DO.entity_count(F.col("format")))})
    judged = DO.score_xml(scanned, "format").withColumn("own", _verdict(
        F.col("score"), _codes(F.col("code")), F.coalesce("entities", "total_elements"))).drop("entities", "score", "code", "ok")
    offered = DO.service_inventory(judged, "format")
    return offered.withColumn("found", F.when(F.col("format").isin(*SERVICES), _verdict(
        F.col("score"), _codes(F.col("code")), F.col("offered"))).otherwise(F.col("own")))


def _json(files: DataFrame) -> DataFrame:
    judged = DO.json_outcome(files, "text")
    return judged.withColumn("found", _verdict(F.col("score"), _codes(F.col("code")), F.coalesce("elements", "top_keys")))


def _geojson(files: DataFrame) -> DataFrame:
    judged = DO.geojson_features(files, "text")
    return judged.withColumn("found", _verdict(F.col("score"), _codes(F.col("code")), F.col("features")))


def _calendars(files: DataFrame) -> DataFrame:
    judged = DO.calendar_outcome(files, "text")
    return judged.withColumn("found", _verdict(F.col("score"), F.col("codes"), F.col("events")))


def _plain_text(files: DataFrame) -> DataFrame:
    """Free text and tables alike: how many lines carry text; tables are scored by their rows later."""
    filled = F.size(F.filter(lines_of(F.col("text")), lambda line: line.rlike(r"(?U)\S")))
    counted = computed(files, {"filled": F.when(F.col("text").isNotNull(), filled)})
    return counted.withColumn("found", _verdict(
        F.when(F.col("filled") > 0, 100).otherwise(0), _codes(F.when(F.col("filled") == 0, "sin-contenido")), F.col("filled")))


def _images(files: DataFrame) -> DataFrame:
    body = F.col("content")
    good = F.when(F.col("format") == "JPEG", SN.is_jpeg(body)).otherwise(SN.is_ecw(body))
    code = F.when(SN.looks_like_html(body), "no-es-imagen").when(~good, "firma-invalida")
    return files.withColumn("found", _verdict(F.when(code.isNull(), 100).otherwise(0), _codes(code)))


def _untyped(files: DataFrame) -> DataFrame:
    judged = SN.type_conformance(F.col("format"), SN.detected_type(F.col("content")))
    return files.withColumn("found", _verdict(judged["score"], _codes(judged["code"])))


def _workbooks(files: DataFrame) -> DataFrame:
    body = F.col("content")
    code = F.when(SN.is_ole2(body), "xls-legado").when(~SN.starts_with(body, SN.MAGIC_ZIP) | SN.is_truncated_zip(body), "xlsx-invalido")
    # Without its cells a workbook that opens is not measured.
    return files.withColumn("found", _verdict(F.when(code == "xlsx-invalido", 0), _codes(code)))


def _packages(files: DataFrame) -> DataFrame:
    body = F.col("content")
    code = (
        F.when(SN.looks_like_html(body), "no-es-archivo").when(~SN.starts_with(body, SN.MAGIC_ZIP), "zip-invalido")
        .when(SN.is_truncated_zip(body), "descarga-truncada"))
    return files.withColumn("found", _verdict(F.when(code.isin("no-es-archivo", "zip-invalido"), 0), _codes(code)))


#: The formats of a collection and what answers for each.
AUDITS = (
    Audit((*XML_FORMATS, *SERVICES), _markup), Audit(("JSON",), _json), Audit(("GeoJSON",), _geojson), Audit(("iCal",), _calendars),
    Audit(DELIMITED, _plain_text), Audit(IMAGES, _images), Audit(UNTYPED, _untyped), Audit(("XLSX",), _workbooks), Audit(("SHP",), _packages),
)


def lines_of(text: Column) -> Column:
    """Physical lines of a whole text; the end of the last line opens no further one."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")


def route(files: DataFrame, audits: tuple[Audit, ...] = AUDITS) -> DataFrame:
    """(file_id, format, content) with ``text`` decoded and ``verdict``, null for formats nobody answers for."""
    current = computed(files.select("file_id", "format", "content"), {
        "whole": F.when(F.col("format").isin(*TEXT_FORMATS), decode_text(F.col("content"))),
        "void": F.octet_length(F.col("content").cast("binary")) == 0})
    broken = F.col("whole").isNull() & F.col("format").isin(*TEXT_FORMATS) & F.col("content").isNotNull()
    current = current.withColumn("verdict", F.when(F.col("void"), _verdict(F.lit(None), _codes(F.lit("archivo-vacio")))).when(
        broken, _verdict(F.lit(0), _codes(F.lit("error-encoding")))))
    kept = current.columns
    for audit in audits:
        mine = F.col("format").isin(*audit.formats)
        found = audit.run(current.withColumn("text", F.when(mine, F.col("whole"))))
        current = found.select(*[c for c in kept if c != "verdict"], F.when(
            F.col("verdict").isNull() & F.col("content").isNotNull() & mine, F.col("found")).otherwise(F.col("verdict")).alias("verdict"))
    return current.select("file_id", "format", "content", F.col("whole").alias("text"), "verdict")


def by_audits(files: DataFrame, audits: tuple[Audit, ...] = AUDITS) -> list[tuple[DataFrame, tuple[Audit, ...]]]:
    """The files, written once, parted by the audits that answer for their format, and these audits; none for other formats."""
    answers = {f: tuple(a for a in audits if f in a.formats) for a in audits for f in a.formats}
    parts = list(dict.fromkeys(answers.values()))
    part = F.lit(None).cast("int")
    for k, own in enumerate(parts):
        part = F.when(F.col("format").isin(*(f for f, a in answers.items() if a == own)), k).otherwise(part)
    kept = files.withColumn("__part", F.coalesce(part, F.lit(len(parts))))
    target = f"{checkpoint_dir(files.sparkSession).rstrip('/')}/collection-files-{uuid.uuid4().hex}"
    kept.write.partitionBy("__part").parquet(target)
    back = files.sparkSession.read.schema(kept.schema).parquet(target)
    return [(back.filter(F.col("__part") == k).drop("__part"), own) for k, own in enumerate([*parts, ()])]


def table_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of all tables among the files, as ``audit_rows`` takes them, with the flag ``shaped``.

    CSV files; text files whose first three filled lines all hold their
    delimiter; records of JSON documents, which are not judged by shape.
    Texts are parsed once: rows and header lines are written together.
    """
    filled = F.slice(F.filter("lines", lambda line: line.rlike(r"(?U)\S")), 1, 3)
    split = computed(files.filter(F.col("format").isin(*DELIMITED) & (F.col("text") != "")).select("file_id", "format", "text"), {
        "lines": lines_of(F.col("text"))}).drop("text")
    parted = computed(split, {"sep": guess_delimiter(F.col("lines")), "filled": filled})
    tabular = (F.col("format") == "CSV") | ((F.size("filled") > 0) & F.forall("filled", lambda line: line.contains(F.col("sep"))))
    tables = computed(parted.filter(tabular), {"header": split_cells(F.get("lines", F.lit(0)), F.col("sep"))})
    lines = tables.select("file_id", "sep", "header", F.posexplode("lines").alias("pos", "line")).select(
        "file_id", F.lit("").alias("sheet"), (F.col("pos") + 1).cast("bigint").alias("row_no"),
        split_cells(F.col("line"), F.col("sep")).alias("tokens"), "header", F.lit(True).alias("shaped"))
    docs = files.filter((F.col("format") == "JSON") & (F.col("text") != "")).select("file_id", "text")
    records = DO.record_rows(DO.json_records(docs)).select(
        "file_id", F.lit("").alias("sheet"), "row_no", "tokens", "header", F.lit(False).alias("shaped"))
    kept = written_table(lines.unionByName(records), "collection-rows")
    own = ["file_id", "sheet", "header", "shaped"]
    # A header alone has no rows.
    headers = kept.filter("shaped and row_no = 1").select(*own)
    named = kept.filter("not shaped").groupBy("file_id", "header").agg(F.count(F.lit(1)).alias("n")).select(
        "file_id", F.lit("").alias("sheet"), "header", F.lit(False).alias("shaped"))
    return kept.filter("row_no > 1"), headers.unionByName(named)


def _by_codes(issues: DataFrame) -> DataFrame:
    """Codes of a file in alphabetical order; at most as many as there are codes."""
    return issues.groupBy("file_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def audit_collection(files: DataFrame, members: DataFrame | None = None, cells: DataFrame | None = None,
                     audits: tuple[Audit, ...] = AUDITS) -> DataFrame:
    """(file_id, format, score, codes, entities) of every file of a mixed collection.

    ``files``: (file_id, format, content).  ``members`` (archive_id, name, size,
    zip_size) lists what packages hold, ``cells`` (file_id, sheet, row_no, col,
    field, raw) the data cells of workbooks.  An empty file and a format nobody
    answers for are not measured; null content neither.
    """
    judged = [route(spread(own), answering) for own, answering in by_audits(files.select("file_id", "format", "content"), audits)]
    first = written_table(reduce(DataFrame.unionByName, judged).select(
        "file_id", "format", "verdict", F.when(F.col("format").isin(*DELIMITED, "JSON"), F.col("text")).alias("text")), "collection")
    rows, headers = table_rows(first)
    tables = DF.audit_rows(rows, headers, shaped="shaped")
    scored = tables["files"].join(_by_codes(tables["issues"]), "file_id", "left").select(
        "file_id", "score", F.coalesce("codes", _codes(F.col("empty_code"))).alias("codes"), F.col("rows").alias("n"))
    if cells is not None:
        books = DF.audit_cells(cells)
        scored = scored.unionByName(books["files"].join(_by_codes(books["issues"]), "file_id", "left").select(
            "file_id", "score", F.coalesce("codes", _codes(F.col("empty_code"))).alias("codes"), F.col("rows").alias("n")))
    if members is not None:
        packed = DO.audit_manifest(members.withColumnRenamed("archive_id", "file_id"), "file_id")
        parts = F.concat(_codes(F.col("code"), F.when(~F.col("has_projection"), "sin-prj")), F.transform(
            F.filter("missing_parts", lambda p: p != ".shp"), lambda p: F.concat(F.lit("componente-faltante-"), F.substring(p, 2, 9))))
        scored = scored.unionByName(packed.select("file_id", F.when(F.col("code").isNotNull(), 0).otherwise(
            100 - 5 * F.size(parts)).alias("score"), F.sort_array(parts).alias("codes"), F.lit(None).cast("bigint").alias("n")))
    joined = first.join(scored, "file_id", "left")
    # A long form speaks where the bytes themselves were no obstacle.
    open_ = F.col("verdict").isNotNull() & (F.coalesce(F.col("verdict.score"), F.lit(100)) == 100) & ~F.array_contains("verdict.codes", "archivo-vacio")
    use = open_ & (F.col("score").isNotNull())
    return joined.select(
        "file_id", "format", F.when(use, F.col("score")).otherwise(F.col("verdict.score")).alias("score"),
        F.when(use, F.array_union("verdict.codes", "codes")).otherwise(F.coalesce("verdict.codes", _codes(F.lit(None)))).alias("codes"),
        F.when(use, F.coalesce("n", "verdict.entities")).otherwise(F.col("verdict.entities")).alias("entities"))
