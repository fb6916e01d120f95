import pytest
from pyspark.sql import functions as F

from sievework import dims
from sievework.functions import delivery as D
from sievework.functions import issues as I
from sievework.functions import scores as S
from sievework.operators import files as FO
from sievework.operators import rollup as R
from sievework.operators import work as W

SCHEMA = ("file_id bigint, dataset_id bigint, idx int, format string, url string, fetch_status string, "
          "status string, score int, size_bytes bigint, codes array<string>, error_codes array<string>, http_status int")


def files(spark, rows):
    full = [(i, r.get("ds", 1), i, r.get("format", "CSV"), r.get("url", f"u{i}"), r.get("fetch", "downloaded"),
             r.get("status", "ok"), r.get("score"), r.get("size", 10), r.get("codes", []), r.get("errors", []), 200)
            for i, r in enumerate(rows)]
    return FO.classify_delivery(spark.createDataFrame(full, SCHEMA))


STATES = [
    (dict(), "ok", None),
    (dict(status="error", codes=["error-tipo"]), "ok", None),
    (dict(fetch="http_error", codes=["no-es-archivo"]), "no-entrega", "no-es-archivo"),
    (dict(fetch="http_error", codes=["descarga"]), "roto", "descarga"),
    (dict(fetch="unreachable"), "roto", "unreachable"),
    (dict(fetch=None), "roto", "desconocido"),
    (dict(fetch="too_large", status="skipped"), "omitida", "too_large"),
    (dict(fetch="error", codes=["archivo-vacio"]), "omitida", "error"),
    (dict(codes=["error-tipo", "json-invalido"]), "roto", "json-invalido"),
    (dict(status="skipped", codes=["error-validacion"]), "roto", "error-validacion"),
    (dict(status="skipped", codes=["fallo-analizador"]), "no-analizado", "fallo-analizador"),
    (dict(status="skipped", codes=["otra-cosa"]), "omitida", "otra-cosa"),
    (dict(fetch="service", codes=["servicio-no-disponible"]), "roto", "servicio-no-disponible"),
]


@pytest.mark.parametrize("row,state,cause", STATES)
def test_state_and_cause(spark, row, state, cause):
    got = files(spark, [row]).first()
    assert (got.state, got.cause) == (state, cause)


def means(spark, rows):
    return FO.dataset_scores(files(spark, rows)).first()


def test_dataset_means(spark):
    dirty = dict(score=20, status="error", codes=["error-tipo"])
    assert means(spark, [dict(score=100), dirty]).content == 60
    assert means(spark, [dict(score=90), dict(score=0, status="error", codes=["json-invalido"])]).content == 90
    assert means(spark, [dict(score=None, fetch="http_error", status="error", codes=["descarga"])]).content is None
    assert means(spark, [dict(score=85), dict(score=100)]).content == 93
    assert means(spark, [dict(fetch="too_large", status="skipped")]).availability is None


def test_states_sum_to_total(spark):
    s = FO.delivery_summary(files(spark, [r for r, _, _ in STATES])).first()
    assert s.ok + s.roto + s.no_entrega + s.omitida + s.no_analizado == s.total == len(STATES)
    assert FO.delivery_summary(files(spark, [dict()]).limit(0)).first().broken_pct == 0


def composite(spark, m, a, c):
    return spark.range(1).select(S.composite_score(
        F.lit(m).cast("int"), F.lit(a).cast("int"), F.lit(c).cast("int")).alias("x")).first().x


def test_composite(spark):
    assert composite(spark, 100, 50, 100) == 79       # would be 85 without the gate
    assert composite(spark, 70, None, None) == 70
    assert composite(spark, None, None, None) is None
    assert composite(spark, 100, 100, None) == 70
    assert composite(spark, None, 100, 100) == 60


def test_file_status(spark):
    def status(ok, codes):
        return spark.range(1).select(D.file_status(F.lit(ok), F.array(*[F.lit(c) for c in codes])).alias("x")).first().x
    assert status(True, ["error-validacion"]) == "ok"
    assert status(False, ["error-validacion"]) == "skipped"
    assert status(False, ["no-es-imagen"]) == "skipped"
    assert status(False, ["error-tipo"]) == "error"


def test_structural_codes(spark):
    df = spark.createDataFrame([("blank-row",), ("raro",), ("missing-cell",)], "t string")
    got = [tuple(r) for r in df.select(I.structural_code(F.col("t")), I.structural_severity(F.col("t"))).collect()]
    assert got == [("fila-vacia", "error"), ("raro", "error"), ("celda-faltante", "warning")]


def test_content_score(spark):
    def score(e, w, n):
        return spark.range(1).select(I.content_score(F.lit(e), F.lit(w), F.lit(n)).alias("x")).first().x
    assert score(0, 0, 0) == 100 and score(1, 1, 5) == 80 and score(9, 9, 5000) == 0
    assert score(5, 0, 1001) == 30


def test_sets_are_consistent():
    assert "error-validacion" in dims.BLOCKING_CODES and "error-validacion" in dims.LIMITATION_CODES
    assert len(dims.BLOCKING_CODES) == 23 and len(dims.HIGH_IMPACT_CODES) == 14 and len(dims.METADATA_GAPS) == 15
    assert not set(dims.CONTENT_ACTIONS) & set(dims.BLOCKING_CODES)


def test_whole_format_needs_more_than_one(spark):
    rows = [dict(format="SHP", fetch="http_error", codes=["descarga"], ds=1),
            dict(format="SHP", fetch="http_error", codes=["descarga"], ds=2),
            dict(format="ECW", codes=["imagen-corrupta"], ds=3), dict(ds=3)]
    f = files(spark, rows)
    causes = W.systemic_causes(W.file_issue_rows(f), W.format_totals(f)).collect()
    assert [(c.key, c.whole_format, c.datasets) for c in causes] == [
        ("SHP|descarga", True, 2), ("ECW|imagen-corrupta", False, 1)]


def test_fetch_issues(spark):
    rows = [dict(url=""), dict(fetch="too_large"), dict(fetch="unreachable"), dict(size=0), dict(), dict(fetch="error", size=0)]
    got = FO.issues_from_fetch(files(spark, rows)).orderBy("file_id").collect()
    assert [(r.fetch_decides, r.issue_code) for r in got] == [
        ("skipped", None), ("skipped", None), ("error", "descarga"), ("error", "archivo-vacio"), (None, None), ("error", None)]


def test_effectively_empty(spark):
    df = spark.createDataFrame([(b"",), (b" \n\t ",), (b" " * 65,), (b" x ",)], "b binary")
    assert [r.x for r in df.select(FO.is_effectively_empty(F.length("b"), F.col("b")).alias("x")).collect()] == [
        True, True, False, False]


def test_slugs_and_resolution(spark):
    f = files(spark, [dict(format="CSV"), dict(format="csv"), dict(format="GeoJSON"), dict(format="Ñ/1"), dict(format="??")])
    slugged = W.file_slugs(f)
    got = {r.idx: r.slug for r in slugged.collect()}
    assert got == {0: "csv", 1: "csv-2", 2: "geojson", 3: "n-1", 4: "archivo"}
    assert W.resolve_file(slugged, 1, "CSV-2").first().idx == 1
    assert W.resolve_file(slugged, 1, "2").first().slug == "geojson"


def test_alert_levels(spark):
    by_code = spark.createDataFrame(
        [(1, "celda-faltante", 999), (2, "celda-faltante", 1000), (3, "error-tipo", 5), (3, "descarga", 1),
         (4, "fila-vacia", 2)], "dataset_id bigint, code string, cases bigint")
    scored = spark.createDataFrame(
        [(i, f"t{i}", c, 50) for i, c in ((1, 90), (2, 90), (3, 90), (4, 49))],
        "dataset_id bigint, title string, content bigint, composite bigint")
    got = {r.dataset_id: (r.level, [c.code for c in r.causes]) for r in W.alerts(by_code, scored).collect()}
    assert got == {2: ("warning", ["celda-faltante"]), 3: ("critical", ["descarga", "error-tipo"]), 4: ("critical", ["fila-vacia"])}


def test_rollup_levels(spark):
    f = files(spark, [dict(score=90), dict(score=81, ds=2, format="XML")])
    levels = {(r.level, r.dataset_id, r.format): r.avg_score for r in R.report_rollup(f).collect()}
    assert levels == {("dataset", 1, None): 90.0, ("dataset", 2, None): 81.0, ("format", None, "CSV"): 90.0,
                      ("format", None, "XML"): 81.0, ("total", None, None): 85.5}
