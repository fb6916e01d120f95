import glob
import json

from pyspark.sql import functions as F

from sievework.operators import runs as RU
from sievework.sources import reports as RP
from sievework.streaming import arrivals


def result(url, issues=None, **over):
    analysis = None if issues is None else {"ok": True, "score": 80, "issues": issues, "header": ["a"]}
    return {"dataset_id": "d", "idx": 0, "format": "CSV", "url": url, "status": "ok", "analysis": analysis, **over}


ISSUE = {"code": "error-tipo", "severity": "error", "count": 9, "stored": 3,
         "columns": [{"col": 1, "field": "a", "rows": [2, 1, 19], "cells": ["x", "y", "z"]}]}


def read(spark, tmp_path, rows):
    path = tmp_path / "results.json"
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return RP.read_results_json(spark, str(path))


def test_old_shapes_are_normalised(spark, tmp_path):
    rows = [result("u1", [{"code": "a", "severity": "error", "count": 5, "samples": [{"row": 1}, {"row": 2}]},
                          {"code": "b", "severity": "error", "count": 1}, ISSUE]), result("u2")]
    got = {r.url: r for r in read(spark, tmp_path, rows).collect()}
    assert [i.stored for i in got["u1"].analysis.issues] == [2, 0, 3]
    assert got["u2"].analysis is None and len(got["u1"].id) == 16


def test_index_and_detail_round_trip(spark, tmp_path):
    rows = read(spark, tmp_path, [
        result("u1", [ISSUE, {"code": "descarga", "severity": "error", "count": 1, "stored": 0}]), result("u2", []), result("u3")])
    target = str(tmp_path / "report")
    RP.write_report(rows, target)
    index, details = RP.read_report(spark, target), RP.read_details(spark, target)
    flags = {r.url: r.has_detail for r in index.collect()}
    assert flags == {"u1": True, "u2": False, "u3": False}
    assert "columns" not in index.select(F.explode("analysis.issues").alias("i")).select("i.*").columns
    key = index.filter("url = 'u1'").first().id
    assert RP.detail_for(details, key).first().issues[0].columns[0].rows == [2, 1, 19]
    assert RP.detail_for(details, "../etc").count() == 0 and RP.detail_for(details, "abcdef0").count() == 0
    full = {r.url: r for r in RP.rebuild(index, details).collect()}
    assert full["u1"].analysis.issues[0].columns[0].cells == ["x", "y", "z"] and full["u1"].analysis.issues[1].columns is None
    gone = RP.rebuild(index, details.limit(0)).filter("url = 'u1'").first()
    assert gone.analysis.issues[0].columns is None and gone.analysis.issues[0]["count"] == 9


def test_checkpoint(spark, tmp_path):
    lines = [json.dumps({"url": "a", "result": result("a", status="old")}), "{broken", "", json.dumps({"url": "", "result": {}}),
             json.dumps({"url": "b", "result": 5}), json.dumps({"url": "a", "result": result("a", status="new")}),
             json.dumps({"url": "c", "result": result("c")})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ck.jsonl").write_text("\n".join(lines), encoding="utf-8")
    done = RP.read_checkpoint(spark, str(tmp_path / "in"))
    assert {r.url: r.result.status for r in done.collect()} == {"a": "new", "c": "ok"}
    skip = spark.createDataFrame([("c",)], "url string")
    RP.write_checkpoint(done, str(tmp_path / "out"), skip)
    assert [r.url for r in RP.read_checkpoint(spark, str(tmp_path / "out")).collect()] == ["a"]


def test_resume_keys_include_the_dataset(spark):
    cat = spark.createDataFrame([(1, "u"), (2, "u"), (1, "v")], "dataset_id int, url string")
    done = spark.createDataFrame([(1, "u"), (1, "v")], "dataset_id int, url string")
    forced = spark.createDataFrame([(1, "v")], "dataset_id int, url string")
    assert [tuple(r) for r in RU.resume_backlog(cat, done).collect()] == [(2, "u")]
    assert sorted(tuple(r) for r in RU.resume_backlog(cat, done, forced).collect()) == [(1, "v"), (2, "u")]


def test_export_bytes(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), ("a;b", None)], "a string, b int").coalesce(1)
    RP.export_csv(df, str(tmp_path / "out"))
    data = open(glob.glob(str(tmp_path / "out" / "part-*"))[0], "rb").read()
    assert data == "﻿a;b\r\n'=x;1\r\n\"a;b\";\r\n".encode("utf-8")


def test_stream_audits_new_files_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "a.html").write_bytes(b"<html></html>")
    (source / "b.json").write_bytes(b"[1]")
    run = lambda: arrivals.audit_stream(arrivals.file_stream(spark, str(source), 1), arrivals.audit_payloads, "path", target, state)
    run()
    assert spark.read.parquet(target).count() == 2
    (source / "c.bin").write_bytes(b" \n ")
    run()
    run()
    got = {r.path[-6:]: (r.kind, r.code, r.empty) for r in spark.read.parquet(target).collect()}
    assert got == {"a.html": ("html", "no-es-archivo", False), "b.json": ("json", "tipo-detectado", False),
                   "/c.bin": ("texto", "archivo-vacio", True)}
    # The same key arriving in another file does not get a second result.
    assert spark.read.parquet(target).groupBy("path").count().filter("count > 1").count() == 0


def test_stream_knows_keys_without_reading_results(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "k int, content string"

    def arrive(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
        return arrivals.audit_stream(stream, arrivals.audit_payloads, "k", target, state)

    def results():
        return sorted((r.k is not None, r.k or 0, r.kind) for r in spark.read.parquet(target).collect())

    arrive([(1, "<html>"), (2, "[1]"), (2, "[1]"), (None, "{}")], "a")
    assert results() == [(False, 0, "json"), (True, 1, "html"), (True, 2, "json")]
    # Without the earlier results at hand, keys already seen are still known.
    target = str(tmp_path / "out2")
    query = arrive([(2, "<html>"), (3, "<a/>"), (None, "[]")], "b")
    assert results() == [(True, 3, "xml")]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 4
    assert not query.exception()


def test_replayed_batch_gives_the_same_results(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    spark.createDataFrame([(1, "[1]"), (2, "<html>")], "k int, content string").write.parquet(source)

    def run():
        stream = spark.readStream.schema("k int, content string").parquet(source)
        arrivals.audit_stream(stream, arrivals.audit_payloads, "k", target, str(state))
        return sorted((r.k, r.kind, r.batch) for r in spark.read.parquet(target).collect())

    first = run()
    # As after a failure between the output and the note that the batch is done.
    for note in (state / "commits").glob("*"):
        note.unlink()
    assert run() == first == [(1, "json", 0), (2, "html", 0)]


def test_empty_export_has_its_header(spark, tmp_path):
    RP.export_csv(spark.createDataFrame([], "a string, b int"), str(tmp_path / "out"))
    data = b"".join(open(p, "rb").read() for p in glob.glob(str(tmp_path / "out" / "part-*")))
    assert data == "﻿a;b\r\n".encode("utf-8")


def test_checkpoint_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RP, "RESULTS_PER_FILE", 10)
    done = spark.range(35).coalesce(1).selectExpr("cast(id as string) as url", "struct('CSV' as format) as result")
    RP.write_checkpoint(done, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.json.gz"))) == 4
    assert RP.read_checkpoint(spark, str(tmp_path / "out")).count() == 35


def test_files_meet_their_issues_once(spark, tmp_path):
    from sievework.plans import documents

    spark.sql("select cast(1 as bigint) as o_orderkey, cast(2 as bigint) as o_custkey, 3.5D as o_totalprice").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.sql("select cast(1 as bigint) as l_orderkey, cast(0 as bigint) as l_partkey, 4.0D as l_quantity").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    met = documents.nested_results(spark, str(tmp_path))
    assert [i.code for i in met.first().analysis.issues] == ["error-tipo"]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
