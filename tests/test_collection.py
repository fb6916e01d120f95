"""A mixed collection: every format by its own audit, and the pieces it rests on."""

from pyspark.sql import functions as F

from sievework.functions.encoding import decode_text
from sievework.functions.json_text import computed
from sievework.operators import collection as CO
from sievework.operators import defects as DF
from sievework.sources.delimited import guess_delimiter

ZIP = b"PK\x03\x04" + b"x" * 40 + b"PK\x05\x06" + b"\0" * 18
FILES = [
    ("csv", "CSV", "n;v\n1;2\n2;x\n3;4\n4;5;surplus\n\n".encode()),
    ("csv-latin", "CSV", "nombre;año\nÁvila;1\n".encode("cp1252")),
    ("csv-utf16", "CSV", "a,b\r\nñ,1\r\né,2\r\n".encode("utf-16")),
    ("csv-header", "CSV", b"a|b|c\n"),
    ("csv-broken16", "CSV", b"\xff\xfea\x00b"),
    ("txt-table", "TXT", b"a,b\n1,2\n3,4\n5,6\n"),
    ("txt-free", "TXT", b"some words\n\nmore words"),
    ("txt-blank", "TXT", b" \n\n"),
    ("json-records", "JSON", b'{"r":[{"k":1},{"k":2},{"k":3},{"k":"x"}]}'),
    ("json-object", "JSON", b'{"k":1}'), ("json-bad", "JSON", b'{"k":'), ("json-empty", "JSON", b"[]"),
    ("geo", "GeoJSON", b'{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null}]}'),
    ("xml", "XML", b"<a><b/></a>"), ("xml-bad", "XML", b"<a><b></a>"), ("rss", "RSS", b"<rss><item/><item>A & B</item></rss>"),
    ("kml", "KML", b"<kml/>"), ("rdf", "RDF", b"<r/>"), ("gml", "GML", b"<g><member/></g>"),
    ("wms", "WMS", b"<WMS_Capabilities><Layer/></WMS_Capabilities>"), ("wfs", "WFS", b"<WFS_Capabilities/>"),
    ("ical", "iCal", b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"),
    ("jpeg", "JPEG", b"\xff\xd8\xff\xe0data"), ("jpeg-html", "JPEG", b"<html>"), ("ecw", "ECW", b"nothing"),
    ("bin", "BIN", b"\x89PNG\r\n\x1a\n"), ("other", "OTRO", b"\x01\x02"),
    ("book", "XLSX", ZIP), ("book-old", "XLSX", bytes.fromhex("D0CF11E0A1B11AE1")), ("book-bad", "XLSX", b"PK\x03\x04" + b"x" * 40),
    ("shp", "SHP", ZIP), ("shp-html", "SHP", b"<!doctype html>"), ("shp-no", "SHP", ZIP),
    ("empty", "CSV", b""), ("missing", "JSON", None), ("unknown", "DWG", b"AC10"),
]


def test_every_format(spark):
    files = spark.createDataFrame(FILES, "file_id string, format string, content binary")
    members = spark.createDataFrame([("shp", n, 10, 100) for n in ("a.shp", "a.dbf")] + [("shp-no", "a.txt", 10, 100)],
                                    "archive_id string, name string, size bigint, zip_size bigint")
    cells = spark.createDataFrame([("book", "s", r + 2, 0, "n", v) for r, v in enumerate(["1", "2", "3", "N/D"])],
                                  "file_id string, sheet string, row_no bigint, col int, field string, raw string")
    got = {r.file_id: (r.score, r.codes, r.entities) for r in CO.audit_collection(files, members, cells).collect()}
    assert len(got) == len(FILES)
    want = {
        "csv": (100 - 60, ["celda-extra", "error-tipo", "fila-vacia"], 4), "csv-latin": (100, [], 1), "csv-utf16": (100, [], 2),
        "csv-header": (0, ["sin-datos"], 0), "csv-broken16": (0, ["error-encoding"], None), "txt-table": (100, [], 3),
        "txt-free": (100, [], 2), "txt-blank": (0, ["sin-contenido"], 0), "json-records": (85, ["error-tipo"], 4), "json-object": (100, [], 1),
        "json-bad": (0, ["json-invalido"], None), "json-empty": (0, ["sin-contenido"], 0), "geo": (85, ["geometria-nula"], 1),
        "xml": (100, [], 2), "xml-bad": (0, ["xml-no-bien-formado"], None), "rss": (100, ["xml-reparado"], 2), "kml": (0, ["raiz-invalida"], 0),
        "rdf": (0, ["sin-entidades"], 0), "gml": (100, [], 1), "wms": (100, [], 1), "wfs": (50, ["sin-feature-types"], 0), "ical": (100, [], 1),
        "jpeg": (100, [], None), "jpeg-html": (0, ["no-es-imagen"], None), "ecw": (0, ["firma-invalida"], None),
        "bin": (80, ["tipo-detectado"], None), "other": (0, ["tipo-no-identificado"], None), "book": (85, ["error-tipo"], 4),
        "book-old": (None, ["xls-legado"], None), "book-bad": (0, ["xlsx-invalido"], None),
        "shp": (90, ["componente-faltante-shx", "sin-prj"], None), "shp-html": (0, ["no-es-archivo"], None),
        "empty": (None, ["archivo-vacio"], None), "missing": (None, [], None), "unknown": (None, [], None),
    }
    assert got["shp-no"][0] == 0 and "shp-faltante" in got.pop("shp-no")[1]
    csv = got.pop("csv")
    assert csv[1:] == want.pop("csv")[1:]
    assert got == want


def test_later_audits_answer_for_their_formats(spark):
    def always(files):
        return files.withColumn("found", CO._verdict(F.lit(7), CO._codes(F.lit("propio"))))

    files = spark.createDataFrame([("a", "DWG", b"x"), ("b", "iCal", b"x")], "file_id string, format string, content binary")
    got = {r.file_id: (r.score, r.codes) for r in CO.audit_collection(files, audits=(*CO.AUDITS, CO.Audit(("DWG",), always))).collect()}
    assert got == {"a": (7, ["propio"]), "b": (0, ["ical-invalido"])}
    assert CO.audit_collection(files.limit(0)).count() == 0


def test_files_meet_the_audits_of_their_format_only(spark):
    def picky(files):
        checked = computed(files, {"mine": F.when(F.col("format") == "DWG", True).otherwise(F.raise_error(F.lit("another format")).cast("boolean"))})
        return checked.withColumn("found", CO._verdict(F.when(F.col("mine"), 7), CO._codes(F.lit("propio"))))

    files = spark.createDataFrame([*FILES, ("none", None, b"x")], "file_id string, format string, content binary")
    got = {r.file_id: (r.score, r.codes) for r in CO.audit_collection(files, audits=(*CO.AUDITS, CO.Audit(("DWG",), picky))).collect()}
    assert len(got) == len(FILES) + 1
    assert got["unknown"] == (7, ["propio"]) and got["ical"] == (100, []) and got["none"] == (None, [])


def test_row_verdicts_need_no_exchange(spark):
    files = spark.createDataFrame(FILES, "file_id string, format string, content binary")
    plan = CO.route(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Scan") == 1


def test_decoding(spark):
    texts = ["plain", "ñandú €", "a😀b", ""]
    rows = [(t, name, mark + t.encode(name)) for t in texts for name, mark in (
        ("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"),
        ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff"))]
    rows += [("ñandú€ x", "cp1252", "ñandú€ x".encode("cp1252")), (None, "odd", b"\xff\xfea"), (None, "lone", b"\xff\xfe\x00\xd8a\x00"), (None, "none", None),
             ("\U0001d800", "utf-32-be", b"\0\0\xfe\xff" + "\U0001d800".encode("utf-32-be"))]
    df = spark.createDataFrame(rows, "want string, name string, raw binary")
    for r in df.withColumn("got", decode_text(F.col("raw"))).collect():
        assert r.got == r.want, (r.name, r.raw)


def test_delimiter_fallback(spark):
    cases = [(["a|b|c"], "|"), (["one column", "two"], ","), (["x;y", "1;2"], ";"), ([""], ","), (["a,b;c,d"], ","), (["a\tb", "", "c\td"], "\t")]
    df = spark.createDataFrame([(c, w) for c, w in cases], "lines array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", guess_delimiter(F.col("lines"))).collect())


def test_profiles_reach_to_the_widest_row(spark):
    rows = spark.createDataFrame([("f", "", 2, ["1", "2", "3"], ["a", "b"]), ("f", "", 3, ["4"], ["a", "b"])],
                                 "file_id string, sheet string, row_no bigint, tokens array<string>, header array<string>")
    headers = spark.createDataFrame([("f", "", ["a", "b"])], "file_id string, sheet string, header array<string>")
    audit = DF.audit_rows(rows, headers)
    got = {p.name: (p.type, p.null_count, p["distinct"]) for p in audit["profiles"].collect()}
    assert set(got) == {"a", "b", "Col 3"} and got["Col 3"][1:] == (1, 1)
    assert {f.code for f in audit["findings"].collect()} == {"celda-extra", "celda-faltante"}


def test_files_are_dealt_over_the_cluster(spark, monkeypatch):
    files = spark.createDataFrame([("t", "TXT", bytearray(b"x"))], "file_id string, format string, content binary")
    seen, whole = [], CO.route
    monkeypatch.setattr(CO, "route", lambda dealt, audits: seen.append(dealt) or whole(dealt, audits))
    assert CO.audit_collection(files).count() == 1
    assert "RebalancePartitions" in seen[0]._jdf.queryExecution().analyzed().toString()
