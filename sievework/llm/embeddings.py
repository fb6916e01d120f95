"""Embedding near-duplicates by int8 tile products with error bounds.

Vectors are scaled to length one and quantised to int8 with a scale each; the
length of what the quantisation loses is kept per vector.  For two vectors
x = sq + e and y = tr + f the product of the quantised parts is off by at most
|e| |tr| + |sq| |f| + |e| |f| (Cauchy-Schwarz), so a pair can only reach the
threshold if the tile product plus this bound does.  Products of int8 values
are exact in float32 matrix products while their sum stays under 2**24, else
in float64.  Pairs that may reach it are computed again in double precision.

Equal vectors are collapsed first.  Vectors are dealt into blocks by hash and
packed as bytes, in single precision where that is what is given; each pair of
blocks is a task's work, in strips of rows and columns.  Columns are ordered by
scale, so the largest product of a row in a strip tells whether any pair of it
may reach the threshold.  What leaves a task is, per vector, the number of
links and a spanning forest of the links, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components have no links and are a component each; vectors of different
lengths are never linked; repeated rows are linked as equal vectors; other
columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sievework.llm.components import components
from sievework.llm.shared import written
from sievework.llm.simhash import spanning

THRESHOLD = 0.95
#: Most rows of a block and most components of its vectors together.
BLOCK, BLOCK_VALUES = 32_768, 1 << 23
#: Vectors of one length are dealt into so many blocks at least, where each has so many rows: else few tasks would have all the work.
LEAST_BLOCKS, LEAST_ROWS = 8, 1024
#: Rows and columns of a strip of a tile.
STRIP, COLUMNS = 512, 1024
_PACK_BYTES = 1 << 20
_MAX_TASKS = 10_000
_MAX_PAIRS = 1_000_000


class Quantised:
    """Unit vectors as int8 with scale, quantised length and length of the error."""

    def __init__(self, vectors: np.ndarray):
        # By a power of two, which rounds nothing: squares of very large or small components stay within doubles.
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
        self.unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.length = np.sqrt((near ** 2).sum(axis=1))
        # A little above, for the rounding of these sums themselves.
        self.error = np.sqrt(((self.unit - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def tile(x: Quantised, y: Quantised, threshold: float, same: bool):
    """(row of x, row of y) of all pairs with a cosine of at least ``threshold``, strip by strip; each pair once if ``same``."""
    kind = np.float32 if x.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    order = np.argsort(y.scale, kind="stable")
    rows_of = order if same else np.arange(len(x.codes))
    left = x.codes[rows_of].astype(kind)
    for start in range(0, len(order), COLUMNS):
        columns = order[start:start + COLUMNS]
        right, scale = y.codes[columns].astype(kind).T.copy(), y.scale[columns]
        length, error = y.length[columns].max(), y.error[columns].max()
        for first in range(0, min(len(left), start + COLUMNS) if same else len(left), STRIP):
            rows = rows_of[first:first + STRIP]
            product = left[first:first + STRIP] @ right
            # Product at which the bound lets the pair reach the threshold; the largest error of the strip serves all.
            slack = x.error[rows] * length + (x.length[rows] + x.error[rows]) * error
            least = (threshold - slack) / x.scale[rows]
            least -= 1e-5 * np.abs(least)
            top = product.max(axis=1)
            hit = np.flatnonzero(top * np.where(top > 0, scale[-1], scale[0]) >= least)
            if not len(hit):
                continue
            i, j = np.nonzero(product[hit] * scale >= least[hit, None])
            i = hit[i]
            if same:
                once = first + i < start + j
                i, j = i[once], j[once]
            i, j = rows[i], columns[j]
            if len(i):
                exact = np.einsum("ij,ij->i", x.unit[i], y.unit[j])
                yield i[exact >= threshold], j[exact >= threshold]


def _packed(table: pa.Table, kind: type) -> pa.Table:
    """The vectors of a block as bytes, a row for about a megabyte of them."""
    dim = table.column("dim")[0].as_py()
    vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks]).astype(kind).reshape(-1, dim)
    reps, copies = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "n"))
    size = max(1, _PACK_BYTES // (dim * vectors.itemsize))
    cuts = [slice(k, k + size) for k in range(0, len(reps), size)]
    pieces = {name: pa.array([v[c].tobytes() for c in cuts], pa.binary()) for name, v in (("reps", reps), ("copies", copies), ("vectors", vectors))}
    numbers = {name: pa.array([table.column(name)[0].as_py()] * len(cuts), pa.int32()) for name in ("dim", "blocks", "block")}
    return pa.table({**numbers, **pieces})


def _side(table: pa.Table, block: int, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of copies and vectors of one block."""
    mine = table.filter(pa.array(table.column("block").to_numpy() == block))
    joined = [b"".join(v.as_py() for v in mine.column(name)) for name in ("reps", "copies", "vectors")]
    return (np.frombuffer(joined[0], np.int64), np.frombuffer(joined[1], np.int64),
            np.frombuffer(joined[2], kind).reshape(-1, dim).astype(np.float64))


def _tile_table(table: pa.Table, threshold: float, kind: type) -> pa.Table:
    dim, lo, hi = (table.column(name)[0].as_py() for name in ("dim", "lo", "hi"))
    ids_x, n_x, vectors = _side(table, lo, dim, kind)
    x = Quantised(vectors) if len(ids_x) else None
    ids_y, n_y, y = ids_x, n_x, x
    if lo != hi:
        ids_y, n_y, vectors = _side(table, hi, dim, kind)
        y = Quantised(vectors) if len(ids_y) else None
    links_x, links_y = np.zeros(len(ids_x), np.int64), np.zeros(len(ids_y), np.int64)
    a, b, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for i, j in tile(x, y, threshold, lo == hi) if x and y else ():
        np.add.at(links_x, i, n_y[j])
        np.add.at(links_y, j, n_x[i])
        a.append(ids_x[i])
        b.append(ids_y[j])
        size += len(i)
        if size > _MAX_PAIRS:
            a, b = ([v] for v in spanning(np.concatenate(a), np.concatenate(b)))
            size = 0
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = spanning(a, b) if len(a) else (a, b)
    counts = [(ids_x, links_x), (ids_y, links_y)]
    # Rows with b hold a link of the forest, rows without a number of links.
    nodes = np.concatenate([k[v > 0] for k, v in counts])
    return pa.table({
        "a": np.concatenate([a, nodes]), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(nodes), pa.int64())]),
        "links": np.concatenate([np.zeros(len(a), np.int64), *[v[v > 0] for _, v in counts]])})


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    own = table.select(F.col(embedding)).schema[0].dataType
    kind = np.float32 if isinstance(own, ArrayType) and isinstance(own.elementType, FloatType) else np.float64
    given = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    # null, where a component is null or not finite or all are zero
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    given = given.withColumn("usable", usable)
    keyed = given.select("vec_id", F.when(F.col("usable"), F.sha2(F.to_json("vector"), 256)).alias("same"), "vector")
    distinct = keyed.filter("same is not null").groupBy("same").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    distinct, _ = written(distinct.withColumn("dim", F.size("vector")), "vectors")
    rows = F.least(F.lit(block), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    some = F.least(F.lit(LEAST_BLOCKS), F.ceil(F.count(F.lit(1)) / F.lit(LEAST_ROWS)))
    sizes = distinct.groupBy("dim").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), some).cast("int").alias("blocks"))
    tiles = sizes.agg(F.sum(F.col("blocks").cast("bigint") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    dealt = distinct.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    packs = dealt.select("dim", "blocks", "block", "rep", "n", "vector").groupBy("dim", "block").applyInArrow(
        lambda part: _packed(part, kind), "dim int, blocks int, block int, reps binary, copies binary, vectors binary")
    # A number of tasks of its own: sized by their bytes, tiles would share few tasks.
    pairs = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "reps", "copies", "vectors").repartition(
        min(max(1, 2 * int(tiles)), _MAX_TASKS), "dim", "lo", "hi")
    found, _ = written(pairs.groupBy("dim", "lo", "hi").applyInArrow(
        lambda part: _tile_table(part, threshold, kind), "a bigint, b bigint, links bigint"), "tiles")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b is not null").select("a", "b"))
    named = distinct.select("same", "rep", "n").join(counts, "rep", "left").join(
        classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "same").join(named, "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
