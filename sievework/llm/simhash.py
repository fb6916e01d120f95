"""SimHash near-duplicates, compared bit-sliced.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's
shingles.  Fingerprints that differ in at most ``radius`` bits agree wholly in
one of ``radius + 1`` bands, so each band is an exact candidate key.  Inside a
band's bucket all pairs are compared on vertically stored bit planes: bit k of
all rows lies in one packed array, a whole shift of the bucket is compared at
once, and a carry-save counter adds up the differing planes.  A block is given
up as soon as every distance in it exceeds the radius.

Copies are collapsed first: only distinct fingerprints are compared.  Buckets
of more than ``width`` fingerprints are dealt out as pairs of blocks, so none
is gathered in one task, and what leaves a task is a spanning forest of the
links it found, never all of them.

Defined cases: null or blank text has fingerprint 0 and links like any other;
repeated rows share a component; a null id never becomes a component's name
unless nothing else is in it; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.components import components
from sievework.llm.shared import text_bytes, written

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Rows of a block of a large bucket; a task holds two of them at a time.
WIDTH = 4096
_CHUNK = 65_536
_BATCH_ROWS = 20_000
_MAX_PAIRS = 1_000_000
_BLOCK_BYTES = 2048


def text_fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit integer."""
    tokens = text.lower().split()  # ASCII letters and ASCII white space only, as these are bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    first, last = starts[:len(tokens) - size + 1].tolist(), ends[size - 1:].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, len(first), _CHUNK):
        joined_hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[k:k + _CHUNK], last[k:k + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(joined_hashes, np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(first)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp) of every row; mark is a hash of the text that tells rows of one id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            raw, cut = data.tobytes(), offsets.tolist()
            found = [text_fingerprint(raw[cut[k]:cut[k + 1]]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["doc_id", "mark", "fp"])

    words = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(words).alias("mark"), words.alias("text")).mapInArrow(
        run, "doc_id bigint, mark bigint, fp bigint")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components as the links (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[differ], np.minimum(rx, ry)[differ])
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


class PlanePairs:
    """All pairs of rows of the same group within the radius, from vertical bit planes."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray, sides: np.ndarray, radius: int):
        # Largest groups first: at shift d only groups with more than d rows are left, a prefix of the rows.
        _, number, sizes = np.unique(groups, return_inverse=True, return_counts=True)
        order = np.lexsort((number, -sizes[number]))
        self.prints, self.groups, self.sides = prints[order], number[order], sides[order]
        self.sizes, self.radius = np.sort(sizes)[::-1], radius
        self.ends = np.cumsum(self.sizes)
        bits = np.unpackbits(self.prints.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
        width = bits.shape[1]
        # Eight copies, shifted by 0 to 7 rows: any shift is one of them from some byte on.
        self.planes = []
        for shift in range(8):
            moved = np.zeros((BITS, width + 64 + 7), np.uint8)
            moved[:, :max(0, width - shift)] = bits[:, shift:]
            self.planes.append(np.packbits(moved, axis=1))

    def _within(self, shift: int, first: int, stop: int) -> np.ndarray:
        """Packed flags: row and row + shift differ in at most ``radius`` bits (bytes first to stop)."""
        here, there = self.planes[0], self.planes[shift % 8]
        skip = shift // 8
        # Carry-save counter: counter[j] holds bit j of every distance; the last overflows into ``over``.
        levels = max(1, (self.radius + 1).bit_length())
        counter = [np.zeros(stop - first, np.uint8) for _ in range(levels)]
        over = np.zeros(stop - first, np.uint8)
        for k in range(BITS):
            carry = here[k, first:stop] ^ there[k, first + skip:stop + skip]
            for level in counter:
                level ^= carry
                carry = carry & ~level
            over |= carry
            if k % 8 == 7 and (self._beyond(counter, over) == 0xFF).all():
                break
        return ~self._beyond(counter, over)

    def _beyond(self, counter: list[np.ndarray], over: np.ndarray) -> np.ndarray:
        """Flags of distances above the radius: a comparison of the counter's bits with its binary digits."""
        more, same = over.copy(), ~over
        for j in range(len(counter) - 1, -1, -1):
            if self.radius >> j & 1:
                same &= counter[j]
            else:
                more |= same & counter[j]
                same &= ~counter[j]
        return more

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in range(1, int(self.sizes[0]) if len(self.sizes) else 0):
            rows = int(self.ends[np.searchsorted(-self.sizes, -shift, side="left") - 1]) if self.sizes[0] > shift else 0
            last = min(rows, len(self.prints) - shift)
            if last <= 0:
                break
            length = (last + 7) // 8
            for first in range(0, length, _BLOCK_BYTES):
                stop = min(length, first + _BLOCK_BYTES)
                packed = self._within(shift, first, stop)
                if not packed.any():
                    continue
                at = np.flatnonzero(np.unpackbits(packed)) + first * 8
                at = at[at < last]
                same = (self.groups[at] == self.groups[at + shift]) & (
                    (self.sides[at] != self.sides[at + shift]) | (self.sides[at] < 0))
                at = at[same]
                if len(at):
                    yield self.prints[at], self.prints[at + shift]


def _forest(prints: np.ndarray, groups: np.ndarray, sides: np.ndarray, radius: int) -> pd.DataFrame:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for x, y in PlanePairs(prints, groups, sides, radius).links():
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > _MAX_PAIRS:
            a, b = spanning(a, b)
    a, b = spanning(a, b) if len(a) else (a, b)
    return pd.DataFrame({"a": a, "b": b})


def links(prints: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Links (a, b) with the components of all pairs of distinct fingerprints within the radius."""
    cuts = [round(BITS * k / (radius + 1)) for k in range(radius + 2)]
    bands = F.array(*[
        F.shiftrightunsigned(F.shiftleft("fp", cuts[k]), BITS - cuts[k + 1] + cuts[k]) for k in range(radius + 1)])
    keyed = prints.select("fp").distinct().select("fp", F.posexplode(bands).alias("band", "value"))
    sizes = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / F.lit(width)).cast("int")
    rows = keyed.join(sizes, ["band", "value"]).withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "fp", "band", "value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") == F.col("other"), -1).otherwise(0).alias("own"), "block")
    # Within a pair of different blocks only links across count; within one block all do.
    rows = rows.withColumn("side", F.when(F.col("lo") == F.col("hi"), -1).otherwise(F.col("block"))).drop("own", "block")
    keys = ["band", "value", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) < _BATCH_ROWS:
                continue
            key = held[keys].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            start = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            if start:
                yield _forest(held["fp"].to_numpy()[:start], np.cumsum(new)[:start], held["side"].to_numpy()[:start], radius)
                held = held.iloc[start:].reset_index(drop=True)
        if held is not None and len(held):
            key = held[keys].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            yield _forest(held["fp"].to_numpy(), np.cumsum(new), held["side"].to_numpy(), radius)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a bigint, b bigint")


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WIDTH,
) -> DataFrame:
    """(doc_id, mark, fp, component, component_id) of every row; component is the class's smallest fingerprint."""
    marked, _ = written(fingerprints(docs, doc_id, text), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct, radius, width))
    named = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "component").join(least, "component"), "fp").select(
        "doc_id", "mark", "fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WIDTH,
) -> DataFrame:
    """(doc_id, mark, fingerprint, component_id) of every row; component_id is the smallest id reachable by links."""
    return classes(docs, doc_id, text, radius, width).select(
        "doc_id", "mark", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class in ``found`` (doc_id, mark, component): that of the smallest id, null last.

    Where that id has several texts in the class, the one of the smallest hash stays; of repeated rows, the first.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
    kept = found.groupBy("component").agg(first.alias("first")).select("first.__id", "first.__mark")
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__mark"))
    turn = F.row_number().over(Window.partitionBy(F.col("__id"), F.col("__mark")).orderBy("__mark"))
    return docs.join(kept, same).withColumn("__turn", turn).filter("__turn = 1").select(*[docs[c] for c in docs.columns])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of near copies."""
    return one_of_each(docs, classes(docs, doc_id, text, **options), doc_id, text)
