import io
import json
import zipfile

from pyspark.sql import functions as F

from sievework.functions import geo as G
from sievework.functions import sniff as SN
from sievework.functions.json_text import describe
from sievework.operators import documents as DO


def docs(spark, texts, **extra):
    rows = [(i, t, *[v[i] for v in extra.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id bigint, text string" + "".join(f", {k} string" for k in extra))


def test_xml_family(spark):
    cases = [
        ("RSS", "<rss><channel><item/><item/></channel></rss>", None, 100, 2),
        ("RSS", "<rss><channel/></rss>", "sin-entidades", 0, 0),
        ("KML", '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark/></kml>', None, 100, 1),
        ("KML", "<kml><Placemark/></kml>", "raiz-invalida", 0, 1),
        ("XML", "<a>uno & dos\x07</a>", "xml-reparado", 100, None),
        ("XML", "<a><b></a>", "xml-no-bien-formado", 0, None),
        ("XML", "", "xml-no-bien-formado", 0, None),
        ("XML", "<a/>trailing", "xml-no-bien-formado", 0, None),
        ("GML", "<c><featureMember/><member/></c>", None, 100, 1),
        ("GML", "<c><member/><member/></c>", None, 100, 2),
        ("XML", '<?xml version="1.0" encoding="ISO-8859-1"?><a>ñ</a>', None, 100, None),
    ]
    d = docs(spark, [c[1] for c in cases], kind=[c[0] for c in cases])
    got = DO.score_xml(DO.xml_inventory(d)).orderBy("file_id").collect()
    for row, (kind, text, code, score, n) in zip(got, cases):
        assert (row.code, row.score, row.entities) == (code, score, n), text


def test_json_records(spark):
    texts = [
        '{"a": {"b": {"c": {"deep": [{"x": 1}]}}}}',               # four levels down: found
        '{"a": {"b": {"c": {"d": {"deeper": [{"x": 1}]}}}}}',      # five: not found
        '{"z": [{"q": 1}], "b": [{"w": 2}]}',                       # tie: first in the document
        '{"s": "[{\\"x\\": 1}]", "n": [1, 2, 3]}',                  # text and plain lists are no records
        "[]", "not json",
        '{"r": [{"k": 1, "v": {"y": [1, 2]}}, 5, {"v": null}]}',
        '[{"element": {"a": 1}}, {"other": {"a": 2}}]',             # different wrappers stay
    ]
    records = DO.json_records(docs(spark, texts))
    got = {r.file_id: (r.path, len(r["items"])) for r in records.collect()}
    assert got == {0: ("a.b.c.deep", 1), 2: ("z", 1), 6: ("r", 3), 7: ("", 2)}
    quoted = ['{"a": " [{}]", "b": "\\u007b\\"x\\": [1]}", "c": {"d": [[2]]}}', '{"a": "[{}]", "b": [{"x": "{"}]}', '[{"w": "{}"}, {"w": "{}"}]', '[{"w": {}}, {"w": {}}]']
    paths = {r.file_id: (r.path, r.layout) for r in DO.json_records(docs(spark, quoted)).collect()}
    assert paths == {0: ("c.d", "lists"), 1: ("b", "objects"), 2: ("", "objects"), 3: ("[].w", "objects")}
    rows = DO.record_rows(records).filter("file_id = 6").orderBy("row_no").collect()
    assert [r.tokens for r in rows] == [["1", '{"y":[1,2]}'], ["5"], ["", ""]]
    assert [r.irregular for r in rows] == [False, True, True]


def test_json_outcome(spark):
    got = [(r.kind, r.code, r.score) for r in DO.json_outcome(docs(spark, ["[]", "{}", "null", "{", "7", '{"a":1}'])).orderBy("file_id").collect()]
    assert got == [("list", "sin-contenido", 0), ("object", "sin-contenido", 0), ("null", "sin-contenido", 0),
                   (None, "json-invalido", 0), ("number", None, 100), ("object", None, 100)]
    assert docs(spark, ["[1,2]"]).select(describe(F.col("text")).alias("d")).first().d == "Array · 2 elementos"


def test_json_search(spark):
    nodes = DO.json_nodes(docs(spark, ['{"Calle": {"dir": [{"num": "12B"}, null]}, "x": true}']))
    assert {r.path for r in nodes.collect()} == {"Calle", "Calle.dir", "Calle.dir[0]", "Calle.dir[0].num", "Calle.dir[1]", "x"}
    hits = DO.search_json(nodes, "12b")
    assert [r.path for r in hits.collect()] == ["Calle.dir[0].num"]
    assert [r.path for r in DO.search_json(nodes, "CALLE").collect()] == ["Calle"]
    assert DO.search_json(nodes, "  ").count() == 0
    assert {tuple(r) for r in DO.open_json_paths(hits).collect()} == {
        (0, "", 1), (0, "Calle", 1), (0, "Calle.dir", 1), (0, "Calle.dir[0]", 1)}


def plain_nodes(value, path="", above=()):
    """Every node below a parsed value, by recursion."""
    if not isinstance(value, dict | list):
        return
    listed = isinstance(value, list)
    for name, child in enumerate(value) if listed else value.items():
        place = f"{path}[{name}]" if listed else f"{path}.{name}" if path else name
        branch = isinstance(child, dict | list)
        leaf = None if branch else child if isinstance(child, str) else json.dumps(child)
        yield place, None if listed else name, leaf, (*above, len(path))
        yield from plain_nodes(child, place, (*above, len(path)))


def test_json_nodes_of_any_depth(spark):
    deep = '{"a":[' * 12 + '{"ñ.x":"[{}]","":"","n":-3,"t":false,"é":null}' + "]}" * 12
    wide = json.dumps({f"k{n}": {"v": [n, str(n)]} for n in range(3000)})
    texts = [deep, wide, "[[],{},[[1]]]", "{", None, "", "7", "null", deep, '{"quote":"a\\"b\\n"}']
    got = DO.json_nodes(docs(spark, texts)).collect()
    want = [(i, *node) for i, text in enumerate(texts) if text and text != "{" for node in plain_nodes(json.loads(text))]
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.file_id, r.path, r.name, r.leaf, tuple(r.ends)) for r in got) == order(want)
    assert all(r.depth == len(r.ends) for r in got) and max(r.depth for r in got) == 25
    assert DO.json_nodes(docs(spark, [None])).count() == 0


def test_geojson(spark):
    texts = ['{"type":"FeatureCollection","features":[{"geometry":{"a":1}},{"geometry":null},5]}',
             '{"type":"FeatureCollection"}', '{"type":"Polygon"}', "[]", "x", '{"type":"Otra"}']
    got = [(r.features, r.null_geometries, r.code, r.score, r.ok) for r in DO.geojson_features(docs(spark, texts)).orderBy("file_id").collect()]
    assert got == [(3, 2, "geometria-nula", 85, False), (0, 0, "sin-features", 90, False), (None, None, None, 100, True),
                   (None, None, "raiz-invalida", 0, False), (None, None, "geojson-invalido", 0, False),
                   (None, None, "tipo-desconocido", 0, False)]


def test_calendar(spark):
    good = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:a\r\n b\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    got = [(r.events, r.codes, r.score) for r in DO.audit_calendars(docs(spark, [good, "BEGIN:VCALENDAR\nmala\nEND:VCALENDAR", "nada"])).orderBy("file_id").collect()]
    assert got == [(1, [], 100), (0, ["errores-linea", "sin-eventos"], 90), (0, ["ical-invalido"], 0)]
    assert sorted(r.name for r in DO.calendar_components(docs(spark, [good])).collect()) == ["VCALENDAR", "VEVENT"]


def archive(names):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in names:
            z.writestr(n, "x" * 10)
    return buf.getvalue()


def test_payloads(spark):
    whole = archive(["a.shp", "a.dbf"])
    cases = [
        (b"", "vacio", "empty"), (b"\n <!DOCTYPE HTML><p>", "html", "web-page"), (b"<?xml?><html>", "html", "web-page"),
        (b"<root/>", "xml", "xml-document"), (b"  [1]", "json", "json-document"), (b"hola", "texto", "other-content"),
        (b"\x00\x01", "binario", "other-content"), (b"\x1f\x8bxx", "gzip", "other-content"),
        (whole, "zip", "other-content"), (whole[:-30], "zip", "truncated-zip"),
        (b'<ServiceExceptionReport><ServiceException code="LayerNotDefined">no</ServiceException></ServiceExceptionReport>',
         "xml", "service-exception"),
    ]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, b binary")
    got = df.select("i", SN.sniff(F.col("b")).alias("kind"), SN.diagnose_payload(F.col("b"), F.lit(200)).alias("d"),
                    SN.is_truncated_zip(F.col("b")).alias("cut")).orderBy("i").collect()
    for row, (data, kind, reason) in zip(got, cases):
        assert (row.kind, row.d.reason) == (kind, reason), data[:20]
    assert [r.cut for r in got if r.kind == "zip"] == [False, True]
    assert got[-1].d.detail == "no (LayerNotDefined)"


def test_zip_end_record_needs_a_whole_byte(spark):
    # The digits of the record straddle bytes: 04 05 04 B0 50 6x is no record.
    odd = b"PK" + b"\x05\x04\xb0\x50\x60" + b"\x00" * 40
    df = spark.createDataFrame([(bytearray(odd),)], "b binary")
    assert df.select(SN.is_truncated_zip(F.col("b")).alias("x")).first().x


def test_conformance(spark):
    cases = [(b"\xff\xd8\xff\xe0", "JPEG", 60, None), (b"\xff\xd8\xff\xe0", "OTRO", 80, "tipo-detectado"), (b"%PDF-1.4", "PDF", 100, None),
             (b"<html>", "BIN", 0, "no-es-archivo"), (b"???", "BIN", 0, "tipo-no-identificado"), (b"{\x00", "JSON", 0, "tipo-no-identificado")]
    for data, declared, score, code in cases:
        got = spark.createDataFrame([(bytearray(data),)], "b binary").select(
            SN.type_conformance(F.lit(declared), SN.detected_type(F.col("b"))).alias("c")).first().c
        assert (got.score, got.code) == (score, code), data


def test_manifest(spark):
    mb = 1024 * 1024
    members = spark.createDataFrame(
        [("a", n, 10, mb) for n in ("X.SHP", "x.dbf", "x.shx", "x.prj")] + [("b", "x.dbf", 10, mb)]
        + [("c", "x.shp", 70 * mb, mb)], "archive_id string, name string, size bigint, zip_size bigint")
    got = {r.archive_id: (r.missing_parts, r.has_projection, r.code, r.score) for r in DO.audit_manifest(members).collect()}
    assert got == {"a": ([], True, None, None), "b": ([".shp", ".shx"], False, "shp-faltante", 0),
                   "c": ([".dbf", ".shx"], False, "paquete-desproporcionado", None)}


def test_projection(spark):
    wkt = ('PROJCS["ETRS_1989_UTM_Zone_30N",SPHEROID["GRS_1980",6378137,298.257222101],PROJECTION["Transverse_Mercator"],'
           'PARAMETER["false_easting",500000],PARAMETER["false_northing",0],PARAMETER["central_meridian",-3],PARAMETER["scale_factor",0.9996]]')
    df = spark.createDataFrame([(500000.0, 0.0, wkt), (440290.0, 4474257.0, wkt), (1.0, 2.0, 'GEOGCS["WGS_84",X]')], "x double, y double, w string")
    out = G.inverse_mercator(df.withColumn("p", G.projection_of(F.col("w"))), "p", "x", "y").collect()
    assert abs(out[0].lon + 3) < 1e-9 and abs(out[0].lat) < 1e-9
    assert abs(out[1].lon + 3.7038) < 1e-3 and abs(out[1].lat - 40.4168) < 1e-3   # Madrid
    assert (out[2].lon, out[2].lat) == (1.0, 2.0)
    none = spark.range(1).select(G.projection_of(F.lit('PROJCS["L",PROJECTION["Lambert"]]')).alias("p")).first().p
    assert none is None


def test_rings_leading_hole(spark):
    rows = [("s", 0, -4.0, 5), ("s", 1, -1.0, 5), ("s", 2, 3.0, 5), ("s", 3, -1.0, 3), ("s", 4, -1.0, 4)]
    rings = spark.createDataFrame(rows, "shape_id string, ring_no bigint, area double, n_points int")
    got = [(r.ring_no, r.polygon, r.is_hole) for r in DO.rings_to_polygons(rings).orderBy("ring_no").collect()]
    assert got == [(0, 1, False), (1, 1, True), (2, 2, False), (4, 2, True)]


def test_large_archives(spark):
    whole = b"PK\x03\x04" + b"\x50" * 300_000 + archive(["a.shp"])
    df = spark.createDataFrame([(0, bytearray(whole)), (1, bytearray(whole[:-40]))], "i int, b binary")
    assert [r.x for r in df.orderBy("i").select(SN.is_truncated_zip(F.col("b")).alias("x")).collect()] == [False, True]


def test_documents_are_dealt_over_the_cluster(spark, monkeypatch):
    """Rows of one input split are dealt before they are parsed; branches are counted by a bounded number of hits a task."""
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    docs = spark.createDataFrame([(k, '{"a":{"k":[1,2]}}') for k in range(40)], "file_id bigint, text string").coalesce(1)
    assert "RebalancePartitions" in plan(DO.json_records(docs))
    hits = DO.search_json(DO.json_nodes(docs), "k")
    monkeypatch.setattr(DO, "HITS_PER_TASK", 10)
    opened = DO.open_json_paths(hits)
    assert "Repartition 4, true" in plan(opened)
    assert sorted({(r.path, r.hits) for r in opened.collect()}) == [("", 1), ("a", 1)] and opened.count() == 80
