import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import metadata as M
from sievework.functions import text as T
from sievework.operators import catalog as CO
from sievework.operators import runs as RU
from sievework.operators import sampling as SA
from sievework.sources import catalog_xml

DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<rdf:RDF xmlns:rdf="r" xmlns:dcat="c" xmlns:dct="t" xmlns:time="m">
  <dcat:Catalog rdf:about="http://example.org/catalog">
    <dcat:dataset><dcat:Dataset rdf:about="http://example.org/ds/1">
        <dct:title>Conjunto de prueba</dct:title>
        <dct:description>con <ol> sin cerrar > y <b>negrita</b></dct:description>
        <dcat:theme rdf:resource="http://datos.gob.es/kos/sector-publico/sector/vivienda"/>
        <dcat:theme rdf:resource="http://datos.gob.es/kos/sector-publico/sector/turismo"/>
        <dcat:keyword>uno</dcat:keyword><dcat:keyword> </dcat:keyword>
        <dct:publisher rdf:resource="http://org/x"/><dct:language>es</dct:language>
        <dct:license rdf:resource="https://creativecommons.org/licenses/by/4.0/"/>
        <dct:accrualPeriodicity><dct:Frequency><rdf:value><time:DurationDescription><time:years>2</time:years></time:DurationDescription></rdf:value></dct:Frequency></dct:accrualPeriodicity>
        <dcat:contactPoint/>
        <dcat:distribution><dcat:Distribution rdf:about="http://example.org/ds/1/csv">
            <dct:format><dct:IMT rdf:value="Text/CSV" rdf:label="CSV"/></dct:format>
            <dcat:accessURL rdf:resource="http://example.org/ds/1/data.csv"/></dcat:Distribution></dcat:distribution>
        <dcat:distribution><dcat:Distribution rdf:about="http://example.org/ds/1/raro">
            <dct:format><dct:IMT rdf:value="x/y"/></dct:format>
            <dcat:accessURL> http://example.org/texto </dcat:accessURL></dcat:Distribution></dcat:distribution>
    </dcat:Dataset></dcat:dataset>
    <dcat:dataset><dcat:Dataset rdf:about="http://example.org/ds/2/">
        <dct:title xml:lang="es">Segundo</dct:title>
        <dcat:distribution><dcat:Distribution><dct:format><dct:IMT rdf:value="text/wms"/></dct:format></dcat:Distribution></dcat:distribution>
    </dcat:Dataset></dcat:dataset>
  </dcat:Catalog>
</rdf:RDF>
"""


def test_catalog_document(spark, tmp_path):
    (tmp_path / "catalog.rdf").write_text(DOCUMENT, encoding="utf-8")
    datasets, files = catalog_xml.read_catalog(spark, str(tmp_path))
    got = [(r.dataset_index, r.dataset_id[-5:], r.idx, r.format, r.url) for r in files.orderBy("dataset_index", "idx").collect()]
    assert got == [(0, "/ds/1", 0, "CSV", "http://example.org/ds/1/data.csv"), (0, "/ds/1", 1, "OTRO", "http://example.org/texto"),
                   (1, "ds/2/", 0, "WMS", "")]
    one, two = datasets.orderBy("dataset_index").collect()
    assert one.description == "con <ol> sin cerrar > y <b>negrita</b>"
    assert (one.category, one.keywords, one.license, one.periodicity, one.contact_point) == ("Cultura", ["uno"], "CC-BY-4.0", 24.0, "presente")
    assert one.formats == ["CSV", "OTRO"] and len(one.files) == 2
    assert (two.title, two.category, two.license, two.formats, two.periodicity) == ("Segundo", "Otros", "Otro", [], None)


def test_filters_are_normalised():
    parse = CO.CatalogFilters.parse
    f = parse({"limit": "25", "sort": "raro", "page": "-3", "analisis": "nada", "categorias": "Salud, ,Otros", "q": "  "})
    assert (f.limit, f.sort, f.page, f.analysis, f.categories, f.query, f.active) == (24, "date-desc", 1, None, ("Salud", "Otros"), None, True)
    assert parse({"limit": "900"}, strict_page_size=False).limit == 200
    assert parse({"limit": "48"}).limit == 48 and not parse({}).active


def catalog(spark, rows):
    schema = ("dataset_id string, title string, description string, publisher string, keywords array<string>, formats array<string>, "
              "category string, license string, issued string, modified string, composite int")
    base = dict(title="t", description="", publisher="", keywords=[], formats=["CSV"], category="Salud", license="Otro", issued="2020-01-01", modified="", composite=None)
    return spark.createDataFrame([tuple({**base, **r}[c.strip().split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_spanish_order_and_unknown_scores_last(spark):
    rows = [dict(dataset_id=str(i), title=t, composite=c) for i, (t, c) in enumerate(
        [("ojo", 5), ("ñandú", 5), ("nube", 9), ("Ávila", None), ("azul", 5)])]
    c = catalog(spark, rows)
    assert [r.title for r in CO.sort_catalog(c, "title-asc").collect()] == ["Ávila", "azul", "nube", "ñandú", "ojo"]
    assert [r.title for r in CO.sort_catalog(c, "quality-desc").collect()] == ["nube", "azul", "ñandú", "ojo", "Ávila"]
    assert [r.title for r in CO.sort_catalog(c, "quality-asc").collect()][-1] == "Ávila"


def test_page_past_the_end(spark):
    c = catalog(spark, [dict(dataset_id=f"{i:03d}") for i in range(30)])
    rows, numbers = CO.catalog_page(c, CO.CatalogFilters(page=9, limit=12, sort="title-asc"))
    assert numbers == {"total": 30, "page": 3, "limit": 12, "total_pages": 3} and rows.count() == 6
    assert CO.catalog_page(c.limit(0), CO.CatalogFilters())[1]["total_pages"] == 1


def test_search(spark):
    c = catalog(spark, [dict(dataset_id="1", title="Bibliotecas  de Ñuble", keywords=["Música"])])
    for query, hit in (("nuble biblio", 1), ("MUSICA", 1), ("música nada", 0), ("", 1)):
        assert CO.filter_catalog(c, CO.CatalogFilters(query=query)).count() == hit, query


def test_refresh_guard(spark):
    n = lambda k: spark.range(k).select(F.col("id").alias("dataset_id"))
    assert CO.accept_refresh(n(499)).first().reason == "too-few"
    assert CO.accept_refresh(n(500)).first().accepted
    assert CO.accept_refresh(n(600), n(1201)).first().reason == "shrunk"
    assert CO.accept_refresh(n(600), n(1200)).first().accepted


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_slugs_and_names(spark):
    slug = lambda s: one(spark, T.dataset_slug(F.lit(s)))
    assert slug("http://x/conjunto/1284123/") == "1284123" and slug("a b/ñ(1)x") == "a%20b%2F%C3%B1(1)x"
    assert one(spark, T.url_basename(F.lit("http://h/a/b%20c+d.csv?x=1#y"))) == "b c+d.csv"
    assert one(spark, T.url_basename(F.lit("http://h/"))) == "http://h/"
    assert len(one(spark, T.url_basename(F.lit("http://h/" + "z" * 200)))) == 90
    assert one(spark, T.url_extension(F.lit("http://h/a.tar.GZ?x=.csv"))) == ".gz"
    assert one(spark, T.url_extension(F.lit("http://h.com/a"))) == ".bin"
    assert one(spark, T.theme_label(F.lit("http://x/sector/medio-ambiente/"))) == "Medio ambiente"
    assert one(spark, T.theme_label(F.lit("http://x/otra_cosa"))) == "Otra cosa" and one(spark, T.theme_label(F.lit(" libre "))) == "libre"
    assert one(spark, T.spatial_label(F.lit("http://x/Espa%C3%B1a"))) == "Espa%c3%b1a"


def test_csv_cells(spark):
    cases = {"=1+1": "'=1+1", "-5": "-5", "-5,25": "-5,25", "-x": "'-x", 'a"b': '"a""b"', "a;b": '"a;b"', "@x": "'@x", "\tx": "'\tx", "a\nb": '"a\nb"', "ok": "ok"}
    for text, want in cases.items():
        assert one(spark, T.csv_cell(F.lit(text))) == want
    assert one(spark, T.csv_cell(F.lit(None).cast("string"))) == ""


def test_wording(spark):
    ts = lambda s: F.lit(datetime.datetime.fromisoformat(s))
    now = ts("2024-06-01T00:00:00")
    for then, want in (("2024-05-31T23:59:30", "hace menos de 1 minuto"), ("2024-05-31T23:00:00", "hace 1 h"), ("2024-05-31T00:00:00", "hace 1 día"),
                       ("2024-04-20T00:00:00", "hace 1 mes"), ("2022-06-01T00:00:00", "hace 2 años"), ("2025-01-01T00:00:00", "futuro")):
        assert one(spark, T.time_ago(ts(then), now)) == want
    assert one(spark, T.long_date(F.lit(datetime.date(2022, 3, 1)))) == "1 de marzo de 2022"
    assert [one(spark, T.periodicity_label(F.lit(m).cast("double"))) for m in (1, 12, 0.2, 2, 0, None)] == [
        "mensual", "anual", "más de una vez al mes", "cada 2 meses", None, None]


def test_freshness_rules(spark):
    now = F.lit(datetime.datetime(2024, 6, 1))
    diag = lambda mod, iss, per: one(spark, M.freshness_diagnosis(F.lit(mod), F.lit(iss), F.lit(per).cast("double"), now))
    assert diag("", "", 1) == "sin-fecha" and diag("2020-01-01", "", None) == "sin-periodicidad"
    assert diag("2024-05-20", "", 1) == "al-dia" and diag("", "2020-01-01", 1) == "no-verificable"
    assert diag("2020-01-01T10:00:00Z", "", 1) == "vencido" and diag("basura", "", 1) == "sin-fecha"


def test_published_sample(spark):
    sizes = dict(a=181, b=23, c=10, d=10, e=6, f=5, g=4, h=1, i=1)
    rows = [(k, j) for k, n in sizes.items() for j in range(n)]
    broken = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id bigint, cause string, j int")
    picked = SA.stratified_sample(broken, 30)
    got = {r.cause: r["count"] for r in picked.groupBy("cause").count().collect()}
    assert got == dict(a=26, b=4, c=2, d=2, e=2, f=3, g=2, h=1, i=1)
    assert sorted(r.j for r in picked.filter("cause = 'b'").collect()) == [0, 7, 14, 21]


def test_sample_stops_at_twice_the_size(spark):
    broken = spark.range(300).select(F.col("id").alias("file_id"), (F.col("id") % 30).cast("string").alias("cause"))
    assert SA.stratified_sample(broken, 10).count() == 20


def test_verdicts(spark):
    def verdict(cause, http=200, size=10, content=b"{}", fmt="CSV", json_ok=False, xml_ok=False, entries=None):
        c = F.lit(bytearray(content)).cast("binary")
        return one(spark, SA.verdict(F.lit(cause), F.lit(fmt), F.lit(http).cast("int"), F.lit(size), c, F.lit(json_ok), F.lit(xml_ok), F.lit(entries).cast("int")))
    assert verdict("descarga") == "discrepa" and verdict("descarga", http=404) == "confirmado" and verdict("descarga", http=None) == "confirmado"
    assert verdict("json-invalido") == "confirmado" and verdict("json-invalido", json_ok=True) == "discrepa"
    assert verdict("zip-invalido", entries=3) == "discrepa" and verdict("zip-invalido") == "confirmado"
    assert verdict("servicio-error", content=b'<ServiceException code="x">n</ServiceException>') == "confirmado"
    assert verdict("servicio-error") == "inconcluso" and verdict("otra") == "inconcluso"
    assert verdict("json-invalido", size=1 << 30) == "inconcluso" and verdict("json-invalido", content=b"<html>") == "confirmado"


def test_matching_by_url_then_position(spark):
    cat = spark.createDataFrame([("d", 0, "a"), ("d", 1, "a"), ("d", 2, "b"), ("d", 3, "z"), ("d", 4, "q")], "dataset_id string, idx int, url string")
    res = spark.createDataFrame([("d", 0, "a", "r0"), ("d", 1, "b", "r1"), ("d", 2, "a", "r2"), ("d", 3, "old", "r3"), ("d", 4, "q", "r4")],
                                "dataset_id string, idx int, url string, result_id string")
    got = [(r.result_id, r.matched_by) for r in RU.match_files(cat, res).orderBy("idx").collect()]
    assert got == [("r0", "url"), ("r2", "url"), ("r1", "url"), ("r3", "position"), ("r4", "url")]


def test_incremental_plan(spark):
    schema = "dataset_id string, url string, idx int, format string, title string"
    cur = spark.createDataFrame([("same", "a", 0, "CSV", "t"), ("new", "b", 0, "CSV", "t"), ("title", "c", 0, "CSV", "t2"), ("fmt", "d", 0, "XML", "t"),
                                 ("more", "e", 0, "CSV", "t"), ("more", "f", 1, "CSV", "t"), ("less", "g", 0, "CSV", "t")], schema)
    prev = spark.createDataFrame([("same", "a", 0, "CSV", "t"), ("title", "c", 0, "CSV", "t"), ("fmt", "d", 0, "CSV", "t"), ("more", "e", 0, "CSV", "t"),
                                  ("less", "g", 0, "CSV", "t"), ("less", "h", 1, "CSV", "t"), ("gone", "i", 0, "CSV", "t"), ("same", "a", 1, "CSV", "t")], schema)
    plan = RU.incremental_plan(cur, prev)
    assert {r.dataset_id: r.plan for r in plan.collect()} == dict(
        same="same", new="new", title="changed", fmt="changed", more="changed", less="changed", gone="removed")
    urls = {r.url for r in RU.forced_urls(cur.withColumn("file_id", F.monotonically_increasing_id()), plan).collect()}
    assert urls == set("bcdefg")


def test_catalogue_repairs_and_rejects(spark, tmp_path):
    dataset = '<dcat:Dataset rdf:about="{0}" p:q="1" p:r="2" p:s="3" p:t="4" p:u="5"><dct:title>{1}</dct:title>{2}</dcat:Dataset>\n'
    (tmp_path / "c.rdf").write_text("<rdf:RDF>\n" + dataset.format("one", "Bread & milk", "") + dataset.format("two", "x", "<dct:issued>") + dataset.format("three", "y", "") + "</rdf:RDF>\n")
    parsed = catalog_xml.parse_datasets(catalog_xml.dataset_fragments(spark, str(tmp_path)))
    got = sorted((r.dataset_id, r.title) for r in catalog_xml.catalog_datasets(parsed).collect())
    assert got == [("one", "Bread & milk"), ("three", "y")]
    lost = catalog_xml.rejected_datasets(parsed).collect()
    assert [r.dataset_index for r in lost] == [1] and "two" in lost[0].xml


@pytest.mark.parametrize("xml,plain", [
    ('<a:b x:y="1" z="see x:y=1 and p:q=\'2\'"/>', '<b y="1" z="see x:y=1 and p:q=\'2\'"/>'),
    ("<b t = 'a:b=\"c\" d:e=\"f\"'  r:about=\"http://h/?k:v=1\">x:y=\"1\"</b>",
     "<b t = 'a:b=\"c\" d:e=\"f\"'  about=\"http://h/?k:v=1\">x:y=\"1\"</b>"),
    ('<p:a\n q:b="1"\n q:c=""><r:d/></p:a>', '<a\n b="1"\n c=""><d/></a>'),
    (' x:y="1" is text', ' x:y="1" is text'),
])
def test_prefixes_go_from_names_only(spark, xml, plain):
    assert spark.range(1).select(catalog_xml.drop_prefixes(F.lit(xml)).alias("x")).first().x == plain


def test_datasets_are_parsed_once_and_rejects_again(spark):
    body = '<dcat:Dataset rdf:about="u"><dct:title xml:lang="es" lang="es">A & B{}</dct:title>{}</dcat:Dataset>'
    rows = [("s", 0, body.format("", "")), ("s", 1, body.format("\x01", "").replace(' lang="es"', "")), ("s", 2, body.format("", "</dct:lost>"))]
    parsed = catalog_xml.parse_datasets(spark.createDataFrame(rows, "source string, dataset_index int, xml string"))
    read = catalog_xml.catalog_datasets(parsed)
    assert [(r.dataset_index, r.title) for r in read.orderBy("dataset_index").collect()] == [(0, "A & B"), (1, "A & B")]
    assert [r.dataset_index for r in catalog_xml.rejected_datasets(parsed).collect()] == [2]
    filters = [line for line in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("from_xml" in line for line in filters)
