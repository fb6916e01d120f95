import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import encoding as EN
from sievework.operators import defects as DF
from sievework.operators import profile as P
from sievework.sources import delimited as DL


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_row_numbers_over_many_splits(spark, tmp_path):
    for i, n in enumerate((4000, 1, 2500)):
        write(tmp_path, f"f{i}.csv", "".join(f"{i}:{k}\n" if k % 7 else "\n" for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = DL.read_lines(spark, str(tmp_path))
        assert lines.count() == 6501
        wrong = lines.filter("value <> '' and split_part(value, ':', 2) <> cast(row_no as string)").count()
        assert wrong == 0
        assert lines.select("file_id", "row_no").distinct().count() == 6501
        assert DL.raw_lines(spark, str(tmp_path)).select("file_id", "block_start").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line,cells", [
    ("a;b;c", ["a", "b", "c"]), ("", [""]), (";", ["", ""]), (";a;;", ["", "a", "", ""]),
    ('"x;y";z', ["x;y", "z"]), ('"a""b";c', ['a"b', "c"]), ('"";x', ["", "x"]), ('a"b;c', ['a"b', "c"]),
    ('"q"tail;z', ["qtail", "z"]), ('"open;z', ['"open', "z"]),
])
def test_split_cells(spark, line, cells):
    assert spark.range(1).select(DL.split_cells(F.lit(line), ";").alias("x")).first().x == cells


@pytest.mark.parametrize("sep", [";", ",", "\t", "|"])
def test_delimiter_is_guessed(spark, tmp_path, sep):
    write(tmp_path, "d.csv", "\n".join(sep.join(r) for r in (["n", "v", "w"], ["1", "2.5", "x"], ["2", "3.5", "y"])))
    rows, headers = DL.read_delimited(spark, str(tmp_path))
    assert headers.first().sep == sep and headers.first().header == ["n", "v", "w"]
    assert [r.tokens for r in rows.orderBy("row_no").collect()] == [["1", "2.5", "x"], ["2", "3.5", "y"]]


def test_clean_file(spark, tmp_path):
    write(tmp_path, "valid.csv", "﻿nombre,edad,ciudad\nAna,28,Soria\nLuis,41,Ávila\nEva,35,León\n")
    rows, headers = DL.read_delimited(spark, str(tmp_path))
    audit = DF.audit_rows(rows, headers)
    assert audit["findings"].count() == 0
    result = audit["files"].first()
    assert (result.score, result.ok, result.rows, result.columns, result.error_cells) == (100, True, 3, 3, 0)
    edad = audit["profiles"].filter("name = 'edad'").first()
    assert (edad.type, edad.min_num, edad.max_num, edad.distinct, edad.null_count) == ("number", 28.0, 41.0, 3, 0)
    assert headers.first().encoding == "utf-8" and headers.first().header[0] == "nombre"


def test_dirty_file(spark, tmp_path):
    text = "nombre;edad;;Nombre \nAna;28;x;1\nLuis;N/D;y;2\n\nEva;30;;3\nLeo;31;z;4;sobra;más\nPaz;33\n  ;\n"
    write(tmp_path, "dirty.csv", text)
    rows, headers = DL.read_delimited(spark, str(tmp_path))
    audit = DF.audit_rows(rows, headers)
    found = {(f.code, f.row_no, f.col, f.cell) for f in audit["findings"].collect()}
    assert found == {
        ("error-tipo", 3, 1, "N/D"), ("fila-vacia", 4, None, None), ("fila-vacia", 8, None, None),
        ("celda-faltante", 5, 2, None), ("celda-extra", 6, 4, "sobra"), ("celda-extra", 6, 5, "más"),
        ("celda-faltante", 7, 2, None), ("celda-faltante", 7, 3, None),
        ("encabezado-vacio", 1, 2, ""), ("encabezado-duplicado", 1, 3, "Nombre "),
    }
    issues = {i.code: (i["count"], i.severity) for i in audit["issues"].collect()}
    assert issues["celda-faltante"] == (3, "warning") and issues["celda-extra"] == (2, "error")
    result = audit["files"].first()
    assert result.score == 100 - 60 - 5 and not result.ok and result.error_cells == 4
    nulls = {p.name: p.null_count for p in audit["profiles"].collect()}
    assert nulls["edad"] == 0 and nulls["Nombre "] == 1


def test_small_blocks_give_the_same_findings(spark, tmp_path):
    body = "".join(f"{i};{'N/D' if i % 9 == 0 else i};{'' if i % 4 == 0 else 'x'}\n" for i in range(300))
    write(tmp_path, "b.csv", "a;b;c\n" + body)
    rows, headers = DL.read_delimited(spark, str(tmp_path), sep=";")
    one = DF.audit_rows(rows, headers)["findings"]
    many = DF.audit_rows(rows, headers, width=17)["findings"]
    assert one.count() == many.count() == 34 + 75
    assert one.exceptAll(many).count() == 0


def test_header_only_file_has_no_data(spark, tmp_path):
    write(tmp_path, "h.csv", "a;b\n")
    rows, headers = DL.read_delimited(spark, str(tmp_path), sep=";")
    result = DF.audit_rows(rows, headers)["files"].first()
    assert (result.score, result.ok, result.empty_code) == (0, False, "sin-datos")


def test_ties_and_few_values_are_not_flagged(spark):
    cells = spark.createDataFrame(
        [("f", "", 0, "tie", r, v) for r, v in enumerate(["1", "2", "true", "false"], 2)]
        + [("f", "", 1, "few", r, v) for r, v in enumerate(["1", "x"], 2)]
        + [("f", "", 2, "text", r, v) for r, v in enumerate(["a", "b", "3", "c"], 2)],
        "file_id string, sheet string, col int, field string, row_no bigint, raw string")
    stats = P.column_stats(P.value_counts(cells))
    assert DF.cell_defects(cells, stats, columns=3).count() == 0


def test_optional_columns_may_be_empty(spark):
    cells = spark.createDataFrame(
        [("f", "", 0, "c", r, v) for r, v in enumerate(["1", None, " ", ""], 2)]
        + [("f", "", 1, "d", r, v) for r, v in enumerate(["1", "2", None, ""], 2)],
        "file_id string, sheet string, col int, field string, row_no bigint, raw string")
    found = DF.cell_defects(cells, P.column_stats(P.value_counts(cells)), columns=2).collect()
    assert sorted((f.col, f.row_no) for f in found) == [(1, 4), (1, 5)]


def test_workbook_sheets_are_judged_apart(spark):
    rows = [("b", s, 0, "v", r, v) for s, vals in (("A", ["1", "2", "3", "x"]), ("B", ["a", "b", "c", "4"]))
            for r, v in enumerate(vals, 2)] + [("b", "A", 0, "v", 9, " ")]
    cells = spark.createDataFrame(rows, "file_id string, sheet string, col int, field string, row_no bigint, raw string")
    audit = DF.audit_cells(cells)
    assert [(f.sheet, f.row_no) for f in audit["findings"].collect()] == [("A", 5)]
    assert audit["files"].first().rows == 8
    assert {p.sheet for p in audit["profiles"].collect()} == {"A"}


def test_cp1252_file(spark, tmp_path):
    write(tmp_path, "w.csv", "año;precio\nPeñafiel;5 €\n".encode("cp1252"))
    rows, headers = DL.read_delimited(spark, str(tmp_path), sep=";")
    assert headers.first().header == ["año", "precio"] and headers.first().encoding == "cp1252"
    assert rows.first().tokens == ["Peñafiel", "5 €"]
    assert DF.encoding_errors(DL.read_lines(spark, str(tmp_path))).count() == 2


def test_detect_encoding(spark):
    cases = {"año".encode(): "utf-8", "año".encode()[:-1]: "utf-8", "añ".encode()[:-1]: "utf-8", "año".encode("cp1252"): "cp1252",
             b"\xef\xbb\xbfa": "utf_8_sig", b"\xff\xfea\x00": "utf_16_le", b"\xfe\xff\x00a": "utf_16_be",
             b"\xff\xfe\x00\x00": "utf_32_le", b"plain": "utf-8", "€".encode()[:-1]: "utf-8", "😀".encode()[:-1]: "utf-8"}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in cases.items()], "b binary, want string")
    for r in df.select("b", "want", EN.detect_encoding(F.col("b")).alias("got")).collect():
        assert r.got == r.want, bytes(r.b)


def test_text_scan(spark, tmp_path):
    write(tmp_path, "a.txt", "\n\nuno; dos\n \ntres; x\ny; z\nsuelto\n")
    write(tmp_path, "b.txt", "linea\notra\n\n")
    write(tmp_path, "c.txt", "\n \n")
    got = {r.file_id[-5:]: (r.lines, r.tabular, r.score, r.code) for r in DL.scan_text(DL.read_lines(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": (4, True, 100, None), "b.txt": (2, False, 100, None), "c.txt": (0, False, 0, "sin-contenido")}


def test_sample_rows(spark):
    rows = spark.range(2, 500).select(F.lit("f").alias("file_id"), F.col("id").alias("row_no"), F.array(F.repeat(F.lit("x"), F.lit(1500))).alias("tokens"))
    kept = P.sample_rows(rows)
    assert kept.count() == 200 and len(kept.first().tokens[0]) == 1000


def records_of(text, sep=";"):
    """First physical row and cells of each record, by the standard reader."""
    reader, out, last = csv.reader(io.StringIO(text, newline=""), delimiter=sep), [], 0
    for record in reader:
        out.append((last + 1, record or [""]))
        last = reader.line_num
    return out


def test_quoted_line_breaks(spark, tmp_path):
    rnd = random.Random(5)
    cells = ['a', '', '"q"', '"x;y"', '"one\ntwo"', '"a""\n\n""b;"', '5" pipe', '"t"ail', '"\n"', 'z"z', '""']
    text = "h1;h2;h3\n" + "".join(";".join(rnd.choice(cells) for _ in range(3)) + "\n" for _ in range(400))
    write(tmp_path, "m.csv", text)
    want = {row: tokens for row, tokens in records_of(text)[1:]}
    for size in (None, "700"):
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows, _headers = DL.read_delimited(spark, str(tmp_path), sep=";", multiline=True)
            got = {r.row_no: r.tokens for r in rows.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want


def test_unclosed_quote_does_not_swallow_the_file(spark, tmp_path):
    write(tmp_path, "u.csv", "a;b\n1;2\n3;\"open\n" + "".join(f"{i};x\n" for i in range(50)))
    rows = DL.join_quoted_lines(
        DL.place_lines(DL.raw_lines(spark, str(tmp_path)), DL.split_table(DL.raw_lines(spark, str(tmp_path))).drop("n", "utf8", "first_line")
                       .selectExpr("*", "'' as sheet", "array('a','b') as header", "';' as sep", "'utf-8' as encoding")), max_lines=20)
    assert rows.count() == 53 and rows.select("row_no").distinct().count() == 53


def test_cells_of_any_length(spark, tmp_path):
    big = ("x" * 50 + '""' + ";") * 40_000
    write(tmp_path, "big.csv", f'a;b\n1;"{big}"\n2;"{big}\n{big}"\n' + "3;" + "1.234" * 60_000 + "\n")
    rows, headers = DL.read_delimited(spark, str(tmp_path), sep=";", multiline=True)
    sizes = {r.row_no: r.n for r in rows.select("row_no", F.length(F.get("tokens", F.lit(1))).alias("n")).collect()}
    one = len(big) - 40_000
    assert sizes == {2: one, 3: 2 * one + 1, 5: 300_000}
    assert DF.audit_rows(rows, headers)["findings"].count() == 0


def test_quoted_records_of_any_number_of_lines(spark, tmp_path):
    long = "\n".join(str(i) for i in range(12_000))
    write(tmp_path, "a.csv", f'a;b\n1;"{long}"\n2;x\n')
    write(tmp_path, "b.csv", 'a;b\n1;"two\nlines"\n2;"never closed\n3;x\n')
    rows, _headers = DL.read_delimited(spark, str(tmp_path), sep=";", multiline=True)
    got = sorted((r.file_id[-5:], r.row_no, r.n) for r in rows.select("file_id", "row_no", F.length(F.get("tokens", F.lit(1))).alias("n")).collect())
    assert [g[:2] for g in got] == [("a.csv", 2), ("a.csv", 12_002), ("b.csv", 2), ("b.csv", 4), ("b.csv", 5)]
    assert got[0][2] == len(long) and got[2][2] == len("two\nlines")


@pytest.mark.parametrize("size", [None, "97", "700"])
def test_records_joined_in_the_scan(spark, tmp_path, size):
    rnd = random.Random(8)
    cells = ['a', '', '"q"', '"x;y"', '"one\ntwo"', '"a""\n\n""b;"', '5" pipe', '"t"ail', '"\n"', 'z"z', '""', '"' + "l\n" * 90 + '"']
    want = {}
    for name in ("a b.csv", "b.csv", "c.csv"):
        text = "".join(";".join(rnd.choice(cells) for _ in range(3)) + "\n" for _ in range(150))
        want[name] = {row: [tokens] for row, tokens in records_of(text)}
        if name == "b.csv":  # never closed: its lines stay rows of their own
            last = text.count("\n")
            text += 'k;"open\n' + "on;and on\n" * 40
            want[name] |= {last + 1: [["k", '"open']]} | {last + 2 + i: [["on", "and on"]] for i in range(40)}
        write(tmp_path, name, text)
    write(tmp_path, "d.csv", "\n".join(["p;q"] * 30))
    want["d.csv"] = {i + 1: [["p", "q"]] for i in range(30)}
    if size:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records, got = DL.read_records(spark, str(tmp_path)), {}
        for r in records.collect():
            got.setdefault(DL.unquote(r.file_id).rsplit("/", 1)[1], {}).setdefault(r.row_no, []).append(r.tokens)
        if not size:  # no record is cut by a split: nothing travels
            assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    finally:
        if size:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


# In UTF-16 and UTF-32 the bytes of some neighbours look like a line feed across two units.
TRICKY = "\u0a85\u0100 \u0100\u0a00\u0a0a\u0a00 \U0001f600 ñ"


@pytest.mark.parametrize("encoding", EN.WIDE)
@pytest.mark.parametrize("marked", [True, False])
def test_wide_lines_over_many_splits(spark, tmp_path, encoding, marked):
    rng = random.Random(7)
    texts = {}
    for name in ("plain.csv", "odd [1] {x} 100%.csv"):
        lines = ["key;text"] + [
            f"{k};" + "".join(rng.choice(TRICKY) for _ in range(rng.choice((0, 3, 40)))) for k in range(150)]
        lines.insert(5, "")
        lines.append("z;" + TRICKY * 200)
        texts[name] = lines
        body = "".join(line + rng.choice(("\n", "\r\n", "\r")) for line in lines).encode(encoding)
        write(tmp_path, name, ("\ufeff".encode(encoding) if marked else b"") + body)
    texts["clean.csv"] = ["key;text", "1;é", "", "2;b", "last"]
    write(tmp_path, "clean.csv", ("\ufeff" * marked + "\n".join(texts["clean.csv"])).encode(encoding))
    if marked:
        write(tmp_path, "narrow.csv", "key;text\n1;a\n2;b\n")
        texts["narrow.csv"] = ["key;text", "1;a", "2;b"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = DL.read_lines(spark, str(tmp_path), None if marked else encoding).collect()
        rows, headers = DL.read_delimited(spark, str(tmp_path), encoding=None if marked else encoding)
        heads = {r.file_id.rsplit("/", 1)[1]: (r.encoding, [c for c in r.header], r.sep) for r in headers.collect()}
        n_rows = rows.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in got:
        found.setdefault(DL.unquote(r.file_id).rsplit("/", 1)[1], []).append((r.row_no, r.value.lstrip("\ufeff")))
    assert {k: sorted(v) for k, v in found.items()} == {
        k: [(i, line) for i, line in enumerate(v, 1)] for k, v in texts.items()}
    assert heads["plain.csv"] == (encoding, ["key", "text"], ";")
    assert n_rows == sum(len(v) - 1 for v in texts.values())


def test_wide_carriage_returns_end_lines_like_in_other_text(spark, tmp_path):
    text = "a;b\r\r\n1;2\r\r\r3;4\r\n"
    wide = write(tmp_path, "w.csv", ("\ufeff" + text).encode("utf-16-be"))
    narrow = write(tmp_path, "n.csv", text)
    lines = lambda path: [(r.row_no, r.value.lstrip("\ufeff")) for r in DL.read_lines(spark, path).orderBy("row_no").collect()]
    assert lines(wide) == lines(narrow) == [(1, "a;b"), (2, ""), (3, "1;2"), (4, ""), (5, ""), (6, "3;4")]


def test_wide_damage_is_kept_visible(spark, tmp_path):
    data = "﻿a;b\n1;x\n".encode("utf-16-le") + b"\x00\xd8" + "y\n".encode("utf-16-le") + b"\x41"
    write(tmp_path, "cut.csv", data)
    rows, _ = DL.read_delimited(spark, str(tmp_path), sep=";")
    assert [(r.row_no, r.tokens) for r in rows.orderBy("row_no").collect()] == [
        (2, ["1", "x"]), (3, ["\ufffdy"]), (4, ["\ufffd"])]


@pytest.mark.parametrize("text,sep", [("a|b|c\n", "|"), ("a\n", ","), ("a;b\n", ";"), ("a,b;c,d\n", ",")])
def test_header_alone_takes_the_most_frequent_delimiter(spark, tmp_path, text, sep):
    write(tmp_path, "h.csv", text)
    assert DL.read_delimited(spark, str(tmp_path))[1].first().sep == sep
