"""Long repeated byte strings, found by sorting a cover of sampled suffixes.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts
anywhere else.  This follows the difference-cover construction of a suffix
array: sort a sample of the suffixes by names that come from recursion on
triples, place the remaining suffixes by their shift to the sample, compare
neighbours.  Two things differ, for the size of what moves (see the README):
it is built only where repeats can be, and the cover is aligned to content.  A
cover by position must hold shifts for every residue and so takes one position
in eleven; a cover counted from anchors holds one in 32 and every two
equal strings have the same shift, under 32, to it.

1. *Zones.*  Every string holds an anchor, the least 8-gram of its first half,
   at a place that depends on the string alone.  A string whose anchor's 100
   following bytes occur once cannot repeat; the others form zones.
2. *Sample.*  In the zones the suffixes at multiples of ``STEP`` before an
   anchor are sampled; each stands for the cell of ``STEP`` strings that start
   up to it.
3. *Names.*  Prefixes get names by recursion on triples: three 8-byte words
   give a 24-byte name, three of those 72 bytes, three of those up to 200.
   The sample is sorted by the name of what all strings of the cell share (169
   bytes) and then by the name of all they cover (231 bytes).  Neighbours with
   the same second name share every string of the cell; a first name that
   occurs once rules them all out.
4. *Merge.*  The strings of the other cells, which lie at the ends of repeats,
   are sorted by the (128-bit) names of their 200 bytes and neighbours compared.

Names are hashes, as repeats need equality and not order.  Texts move once,
and only those with zones go on.  All group work is a sort over rows, so a
string that millions of documents share is spread and spilled, not gathered.

Defined cases: null and empty texts and those under 200 bytes lose nothing;
repeated rows are other rows, so a repeated text of 200 bytes goes wholly in
each; very long texts are worked on in overlapping pieces; other columns are
ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import SLICE_BYTES, slices, text_bytes, written

LENGTH = 200
ANCHOR_BYTES = 100
SELECT = LENGTH - ANCHOR_BYTES + 1
STEP = 32
#: Bytes that all strings of a cell share.
CORE = LENGTH - STEP + 1
_MARGIN = 2 * LENGTH
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray, c: np.ndarray, seed: np.uint64 = _K1) -> np.ndarray:
    """Name of a triple of names."""
    x = (a ^ seed) * _K2
    x ^= x >> np.uint64(29)
    x = (x ^ b) * _K3
    x ^= x >> np.uint64(32)
    x = (x ^ c) * _K1
    x ^= x >> np.uint64(30)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one integer."""
    data = np.ascontiguousarray(data)
    if len(data) < 8:
        return np.empty(0, np.uint64)
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` successive values, by running minima within blocks and from both sides."""
    take = np.minimum if least else np.maximum
    n = len(x)
    padded = np.full(-(-n // width) * width, x[-1], x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    before = take.accumulate(grid, axis=1).ravel()
    after = take.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(after[:n - width + 1], before[width - 1:n])


def _selection(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each 8-gram, and the least value among those a string from each position on chooses from."""
    hashed = ((_words(data).astype(np.uint64) * _K1) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    return hashed, _sliding(hashed, SELECT, True)[:len(data) - LENGTH + 1]


def own_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of one text, and for the string at each position the number of its own (first) anchor."""
    at = anchors(data, np.array([len(data)]))
    hashed, least = _selection(data)
    own = np.searchsorted(at, np.arange(len(least)))
    rest = np.flatnonzero(hashed[at[own]] != least)
    while len(rest):
        own[rest] += 1
        rest = rest[hashed[at[own[rest]]] != least[rest]]
    return at, own


def anchors(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Anchor positions; ``ends`` are the ends of the texts in ``data``, and no string crosses one."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64)
    hashed, least = _selection(data)
    starts = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(data) + 1, np.int32)  # strings that lie in one text
    long = ends - starts >= LENGTH
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - LENGTH + 1, -1)
    least = np.where(np.cumsum(whole)[:len(least)] > 0, least, np.uint32(0))
    # Position p is chosen when it holds the least value of some string that starts at p - SELECT + 1 to p.
    padded = np.concatenate([np.zeros(SELECT - 1, np.uint32), least, np.zeros(SELECT - 1, np.uint32)])
    return np.flatnonzero(_sliding(padded, SELECT, False) == hashed[:len(least) + SELECT - 1])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column("text"))
            keys = part.column("key").to_numpy(zero_copy_only=False)
            if part.num_rows == 1 and len(data) > 2 * SLICE_BYTES:  # a very long text: pieces that overlap by a string
                found = [anchors(data[s:s + SLICE_BYTES + LENGTH - 1], np.array([len(data[s:s + SLICE_BYTES + LENGTH - 1])])) + s
                         for s in range(0, len(data), SLICE_BYTES)]
                at = np.unique(np.concatenate(found))
            else:
                at = anchors(data, offsets[1:])
            words = _words(data)
            name = np.full(len(at), 1, np.uint64)
            steps = [*range(0, ANCHOR_BYTES - 8, 8), ANCHOR_BYTES - 8]
            for a, b in zip(steps[::2], [*steps[1::2], steps[-1]]):
                name = _mix(name, words[at + a], words[at + b])
            row = np.searchsorted(offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(keys[row]), pa.array((at - offsets[row]).astype(np.int32))],
                ["name", "key", "pos"])


class Names:
    """Names of a text's strings: 24, 72 and 200 bytes from every position on."""

    def __init__(self, data: np.ndarray, pad: int = 0):
        zero = np.zeros(pad, np.uint8)
        self.words = _words(np.concatenate([zero, data, zero])).astype(np.uint64)

    @staticmethod
    def _triples(x: np.ndarray, step: int, seed: np.uint64 = _K1) -> np.ndarray:
        n = len(x) - 2 * step
        return _mix(x[:n], x[step:step + n], x[2 * step:2 * step + n], seed) if n > 0 else np.empty(0, np.uint64)

    def of_72(self, seed: np.uint64 = _K1) -> np.ndarray:
        return self._triples(self._triples(self.words, 8, seed), 24, seed)

    def of_200(self, seed: np.uint64 = _K1) -> np.ndarray:
        return self._triples(self.of_72(seed), 64, seed)


def _zone(n: int, places: np.ndarray, back: int) -> np.ndarray:
    """Flags of the string starts within ``back`` before (or at) a place, of a text of n bytes."""
    starts = n - LENGTH + 1
    marks = np.zeros(starts + 1, np.int32)
    np.add.at(marks, np.minimum(np.maximum(places - back, 0), starts), 1)
    np.add.at(marks, np.minimum(places + 1, starts), -1)
    return np.cumsum(marks)[:starts] > 0


def _places(value) -> np.ndarray:
    return np.empty(0, np.int64) if value is None else np.asarray(value, np.int64)


def _text_rows(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[tuple]:
    """(key, bytes, places...) of each row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        keys = batch.column("key").to_pylist()
        columns = [batch.column(name) for name in lists]
        for k in range(batch.num_rows):
            yield keys[k], data[offsets[k]:offsets[k + 1]], *(
                _places(c[k].values.to_numpy(zero_copy_only=False) if c[k].is_valid else None) for c in columns)


def _table(rows: list[tuple[int, tuple[np.ndarray, ...]]], names: list[str]) -> pa.RecordBatch:
    keys = np.repeat(np.array([k for k, _ in rows], np.int64), [len(v[0]) for _, v in rows])
    columns = [np.concatenate([v[j] for _, v in rows]) for j in range(len(rows[0][1]))]
    columns = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, columns)], ["key", *names])


def _batched(found: Iterator[tuple[int, tuple[np.ndarray, ...]]], names: list[str], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for item in found:
        if len(item[1][0]):
            held.append(item)
            size += len(item[1][0])
        if size >= rows:
            yield _table(held, names)
            held, size = [], 0
    if held:
        yield _table(held, names)


def _pieces(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first string, end of strings, first byte, end of bytes) of the pieces a text of n bytes is worked on in."""
    strings = n - LENGTH + 1
    for lo in range(0, strings, SLICE_BYTES):
        hi = min(strings, lo + SLICE_BYTES)
        yield lo, hi, max(0, lo - _MARGIN), min(n, hi + LENGTH + _MARGIN)


def _cells(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of the core, name of all bytes, last string) of the cells with a string whose anchor is one of ``places``."""
    found = []
    for lo, hi, first, end in _pieces(len(data)):
        own_data = data[first:end]
        at, own = own_anchors(own_data)
        strings = np.arange(lo, hi) - first
        anchor = at[own[strings]]
        again = np.isin(anchor + first, places)
        last = np.unique(anchor[again] - (anchor[again] - strings[again]) // STEP * STEP)
        names = Names(own_data, STEP - 1)
        t72, t200 = names.of_72(), names.of_200()
        place = last + STEP - 1
        core = _mix(t72[place], t72[place + (CORE - 72) // 2], t72[place + CORE - 72])
        before, after = np.minimum(last + first, STEP - 1), np.minimum(len(data) - LENGTH - last - first, 0)
        edges = (before * 1024 - after).astype(np.uint64)
        found.append((core, _mix(t200[last], t200[place], edges), last + first))
    core, around, last = (np.concatenate(c) for c in zip(*found))
    last, once = np.unique(last, return_index=True)
    return core[once], around[once], last


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(((key, _cells(data, places)) for key, data, places in _text_rows(batches, "places")), ["name", "around", "pos"])


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for key, data, places in _text_rows(batches, "unsure"):
            flags = _zone(len(data), places, STEP - 1)
            for lo, hi, _, _ in _pieces(len(data)):
                at = np.flatnonzero(flags[lo:hi])
                names = Names(data[lo:hi + LENGTH - 1])
                yield key, (names.of_200()[at], names.of_200(_OTHER)[at], at + lo)

    return _batched(found(), ["name", "check", "pos"])


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for key, data, sure, equal in _text_rows(batches, "sure", "equal"):
        n = len(data)
        starts = _zone(n, sure, STEP - 1)
        starts[equal] = True
        covered = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(starts)
        covered[at] += 1
        covered[at + LENGTH] -= 1
        gone = np.cumsum(covered)[:n] > 0
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = hashlib.sha256(data[~gone].tobytes()).hexdigest()
        # In the text that stays, a character goes only with all of its bytes.
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        whole = np.logical_and.reduceat(gone, heads)
        stays = np.repeat(~whole, np.diff(np.append(heads, n)))
        rows.append((key, int(gone.sum()), spans[::2].tolist(), spans[1::2].tolist(), kept, data[stays].tobytes().decode("utf-8")))
        if len(rows) == 256:
            yield _removal_batch(rows)
            rows = []
    if rows:
        yield _removal_batch(rows)


_REMOVED = "key bigint, n_removed bigint, starts array<bigint>, stops array<bigint>, kept_sha256 string, kept string"


def _removal_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "n_removed", "starts", "stops", "kept_sha256", "kept"])


def removals(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n_removed, starts, stops, kept_sha256, kept) of the texts that may lose bytes; kept is the text that stays.

    ``key`` is a BIGINT that differs between rows of different texts or ids; rows
    that share it are copies of each other and stay apart by their place only.
    """
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    found = base.filter(F.octet_length("text") >= LENGTH).mapInArrow(_anchor_rows, "name bigint, key bigint, pos int")
    by_name = Window.partitionBy("name")
    again = found.withColumn("n", F.count(F.lit(1)).over(by_name)).filter("n > 1")
    places = again.groupBy("key").agg(F.collect_set("pos").alias("places"))
    zoned, _ = written(base.join(places, "key"), "zones")

    sample = zoned.mapInArrow(_sample_rows, "key bigint, name bigint, around bigint, pos int")
    order = by_name.orderBy("around", "key", "pos")
    marked = sample.select(
        "key", "pos",
        (F.coalesce(F.lag("around").over(order) == F.col("around"), F.lit(False))).alias("as_before"),
        (F.coalesce(F.lead("around").over(order) == F.col("around"), F.lit(False))).alias("as_after"),
        (F.min("around").over(by_name) != F.max("around").over(by_name)).alias("mixed"))
    marked = marked.select(
        "key", "pos", (F.col("as_before") | F.col("as_after")).alias("sure"),
        (F.col("mixed") & ~F.col("as_before")).alias("unsure")).filter("sure or unsure")
    lists = marked.groupBy("key").agg(
        F.collect_set(F.when(F.col("sure"), F.col("pos"))).alias("sure"),
        F.collect_set(F.when(F.col("unsure"), F.col("pos"))).alias("unsure"))
    lists, _ = written(lists, "samples")

    opened = zoned.select("key", "text").join(lists.filter(F.size("unsure") > 0), "key").mapInArrow(_open_rows, "key bigint, name bigint, check bigint, pos int")
    names = Window.partitionBy("name", "check")
    equal = opened.withColumn("n", F.count(F.lit(1)).over(names)).filter("n > 1").groupBy("key").agg(
        F.collect_set("pos").alias("equal"))
    return zoned.select("key", "text").join(lists.join(equal, "key", "left"), "key").mapInArrow(_removal, _REMOVED)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    whole = keyed.select("key", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    # Copies under one key have the same text and so the same bytes to lose.
    gone = removals(keyed, "key").groupBy("key").agg(
        F.max("n_removed").alias("n_removed"), F.max(F.size("starts")).cast("bigint").alias("n_spans"),
        F.max("kept_sha256").alias("kept_sha256"))
    none = F.lit(0).cast("bigint")
    return whole.join(gone, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text (whole characters only) and ``n_chars`` counted anew.

    A document of which nothing is left goes; one that was empty or blank before stays.
    """
    marked = docs.withColumn("__key", F.xxhash64(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))))
    cut = removals(marked, "__key", text).filter("n_removed > 0").groupBy("key").agg(F.max("kept").alias("__kept"))
    joined = marked.join(cut.withColumnRenamed("key", "__key"), "__key", "left").filter("__kept is null or __kept <> ''")
    changes = {text: F.coalesce("__kept", text)}
    if n_chars in docs.columns:
        changes[n_chars] = F.when(F.col("__kept").isNull(), F.col(n_chars)).otherwise(
            F.char_length("__kept").cast(docs.schema[n_chars].dataType))
    return joined.withColumns(changes).select(*docs.columns)
