"""Group devices against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from sievework.operators import groups as G
from sievework.operators import issues as IO


def skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    positions = rnd.sample(range(100_000), n)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", p, rnd.randrange(-3, 9)) for p in positions]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v int").repartition(7)


def test_number_within(spark):
    rows, df = skewed(spark)
    want = {}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            want[r[1]] = i
    for width, sparse in ((1, True), (137, False), (137, True), (1_000_000, False)):
        got = {r.pos: r.rn for r in G.number_within(df, ["k"], "pos", width=width, sparse=sparse).collect()}
        assert got == want


def test_sparse_positions(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_WIDTH", 1_000_000)
    ids = [3, 10**9 + 7, 5 * 10**12, 5 * 10**12 + 1, 9 * 10**18]
    df = spark.createDataFrame([(i, "k") for i in ids], "pos bigint, k string")
    got = {r.pos: r.rn for r in G.number_within(df, ["k"], "pos", sparse=True).collect()}
    assert got == {p: i for i, p in enumerate(ids, 1)}


def test_number_whole_table(spark):
    rows, df = skewed(spark)
    got = {r.pos: r.rn for r in G.number_within(df, [], "pos", width=500).collect()}
    assert got == {p: i for i, p in enumerate(sorted(r[1] for r in rows), 1)}


def test_number_with_null_keys(spark):
    df = spark.createDataFrame([(None, 5), (None, 2), ("a", 9)], "k string, pos bigint")
    got = {r.pos: r.rn for r in G.number_within(df, ["k"], "pos", nullable_keys=True).collect()}
    assert got == {2: 1, 5: 2, 9: 1}


def test_running_sum(spark):
    rows, df = skewed(spark)
    want, acc = {}, {}
    for k, p, v in sorted(rows, key=lambda r: r[1]):
        acc[k] = acc.get(k, 0) + v
        want[p] = acc[k]
    got = {r.pos: r.s for r in G.running_sum(df, ["k"], "pos", "v", "s", width=211).collect()}
    assert got == want


def test_repeats(spark):
    rows, df = skewed(spark)
    firsts = {}
    for k, p, v in rows:
        firsts[(k, v)] = min(p, firsts.get((k, v), p))
    want = {p for k, p, v in rows if firsts[(k, v)] != p}
    assert {r.pos for r in G.repeats(df, ["k", "v"], "pos").collect()} == want


def test_join_by_key_spreads_hot_keys(spark):
    rows, df = skewed(spark)
    names = spark.createDataFrame([(k, k.upper()) for k in {r[0] for r in rows} if k != "k3"], "k string, name string")
    left = G.join_by_key(df, names, ["k"], "pos", "left", hot_rows=100, spread=8)
    got = {r.pos: r.name for r in left.collect()}
    assert got == {p: (None if k == "k3" else k.upper()) for k, p, _ in rows}
    inner = G.join_by_key(df, names, ["k"], "pos", "inner", hot_rows=100, spread=8)
    assert inner.count() == sum(k != "k3" for k, _, _ in rows)


def occurrences(spark):
    rows = [("f", "error-tipo", "", c, f"c{c}", r, f"v{r}") for c in (0, 2) for r in (2, 3, 22, 500, 501)]
    rows += [("f", "fila-vacia", "", None, None, r, None) for r in (4, 9)]
    return spark.createDataFrame(rows, "file_id string, code string, sheet string, col int, field string, row_no bigint, cell string")


def test_compact_deltas(spark):
    occ = occurrences(spark)
    packed = IO.compact_occurrences(occ, width=100).filter("code = 'error-tipo' and col = 0 and chunk = 0").first()
    assert packed.rows == [2, 1, 19] and packed.cells == ["v2", "v3", "v22"]
    back = IO.expand_occurrences(IO.compact_occurrences(occ, width=100))
    cols = ["file_id", "code", "col", "row_no", "cell"]
    assert back.select(cols).exceptAll(occ.select(cols)).count() == 0
    assert back.count() == occ.count()


def test_rows_without_cells_keep_none(spark):
    packed = IO.compact_occurrences(occurrences(spark)).filter("code = 'fila-vacia'").first()
    assert packed.rows == [4, 5] and packed.cells is None


def test_cap_and_positions(spark):
    occ = occurrences(spark)
    kept = IO.cap_occurrences(occ, 7).filter("code = 'error-tipo'").collect()
    assert sorted((r.col, r.row_no) for r in kept) == [(0, 2), (0, 3), (0, 22), (0, 500), (0, 501), (2, 2), (2, 3)]
    page = IO.positions(occ, "f", "error-tipo", 4, 3).collect()
    assert [(r.col, r.row_no) for r in page] == [(0, 501), (2, 2), (2, 3)]
    numbered = IO.number_occurrences(occ, width=3).filter("code = 'error-tipo'").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, 11))
    assert [r.cases for r in IO.affected_columns(occ).orderBy("col").collect()] == [5, 5]
