"""Benchmark decontamination with an FM-index per shard of documents.

A task cuts its documents into shards of about ``SHARD_BYTES``.  A shard's
words become numbers, its suffixes are sorted by prefix doubling (only what
is still tied is sorted again), and the Burrows-Wheeler transform is kept as a
wavelet matrix: a bit vector per binary digit of the numbers, with ranks by
popcounts.  Suffix positions are sampled, the first word of each document
always.  The index is a file in the shared folder; it does not depend on the
benchmark and can be searched again.

A second task per shard takes the benchmark's windows in batches.  All windows
of a batch are searched backward at once, a word a step, and leave as soon as
their interval is empty; the rows found step back to the nearest sample, which
gives their places.  The places merge to spans of words to remove.

Defined cases: null and empty text have no words and are clean; an item
without words has no window; windows never cross documents; items with one id
count once, an item with a null id hits words but is not named; rows may
repeat; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.files import create, new_file, open_file
from sievework.llm.shared import dealt, scratch_path, slices, text_bytes, written
from sievework.llm.words import ALNUM, LOWER, Words

WINDOW = 10
#: Bytes of text in a shard (one document at least), distance of samples, places looked up at once, windows at once.
SHARD_BYTES, SAMPLE, AT_ONCE, BATCH = 8_000_000, 16, 500_000, 50_000


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in order; the last number must be there once."""
    n, bits = len(text), max(int(text.max(initial=0)).bit_length(), 1)
    # As many numbers as fit in one key are compared at first.
    step = max(63 // bits, 1)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(step, np.int64)])
    for k in range(step):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(n + 1, np.int64)  # place of the first suffix of the group; past the end is lowest
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        here = order[slots]
        own = rank[here]
        key = (own << 32) | (rank[np.minimum(here + step, n)] + 1)
        turn = np.argsort(key)
        key, here = key[turn], here[turn]
        order[slots] = here
        new = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[here] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        step *= 2
    return order


class Bits:
    """Bit vector with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        out[:len(raw)] = raw
        return out.view("<u8")

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Index:
    """FM-index of the word numbers of a shard; number 0 closes every document."""

    def __init__(self, levels: np.ndarray, zeros: np.ndarray, counts: np.ndarray, marked: np.ndarray, samples: np.ndarray):
        self.parts = {"levels": levels, "zeros": zeros, "counts": counts, "marked": marked, "samples": samples}
        self.levels, self.zeros = [Bits(row) for row in levels], zeros.tolist()
        self.below = np.concatenate([[0], np.cumsum(counts)])  # rows of suffixes that start with a smaller number
        self.marked, self.samples = Bits(marked), samples
        # Where each number's run starts below all levels: the level's ones go behind its zeros.
        place = np.zeros(len(counts), np.int64)
        self.codes = np.arange(len(counts))
        self.shift = self.below[:-1] - self._down(place, self.codes)

    @classmethod
    def built(cls, numbers: np.ndarray, first: np.ndarray) -> Index:
        """Index of documents given as numbers from 1 and the place of each document's first word, and the end."""
        docs = len(first) - 1
        text = np.zeros(len(numbers) + docs, np.int64)
        inside = np.ones(len(text), bool)
        inside[first[1:] + np.arange(docs)] = False
        text[inside] = numbers
        # Ends of documents are all different to the sort, so no comparison goes past one.
        apart = text + docs - 1
        apart[~inside] = np.arange(docs)
        order = sorted_suffixes(apart)
        before = np.where(order > 0, text[order - 1], 0)
        size = int(text.max(initial=0)) + 1
        depth = max((size - 1).bit_length(), 1)
        levels, zeros = [], []
        for k in range(depth):
            ones = (before >> (depth - 1 - k) & 1).astype(bool)
            levels.append(Bits.packed(ones))
            zeros.append(len(ones) - int(ones.sum()))
            before = np.concatenate([before[~ones], before[ones]])
        starts = np.zeros(len(text), bool)
        starts[first[:-1] + np.arange(docs)] = True
        marked = starts[order] | (order % SAMPLE == 0)
        return cls(np.array(levels), np.array(zeros), np.bincount(text, minlength=size), Bits.packed(marked), order[marked].astype(np.int32))

    def _down(self, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(place)
            place = np.where(code >> (len(self.levels) - 1 - k) & 1, zeros + ones, place - ones)
        return place

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each window.

        ``windows`` has a row of numbers each, filled from the right; 0 there is a word the shard does not have.
        """
        width = windows.shape[1] if len(windows) else 0
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.below[-1])
        open_ = np.arange(len(windows))
        for k in range(1, width + 1):
            open_ = open_[sizes[open_] >= k]
            code = windows[open_, width - k]
            low[open_] = np.where(code > 0, self._down(low[open_], code) + self.shift[code], 0)
            high[open_] = np.where(code > 0, self._down(high[open_], code) + self.shift[code], 0)
            open_ = open_[low[open_] < high[open_]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by row."""
        out = np.zeros(len(rows), np.int64)
        open_, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            there = self.marked.at(row)
            out[open_[there]] = self.samples[self.marked.rank(row[there])] + steps
            open_, row, steps = open_[~there], row[~there], steps + 1
            place, code = row, np.zeros(len(row), np.int64)
            for level, zeros in zip(self.levels, self.zeros):
                bit, ones = level.at(place), level.rank(place)
                code = code << 1 | bit
                place = np.where(bit, zeros + ones, place - ones)
            row = place + self.shift[code]
        return out


def _saved(parts: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **parts)
    return out.getvalue()


def _shard_file(folder: str, ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[str, int, int]:
    words = Words(LOWER[data], offsets, ALNUM)
    codes, different = words.codes()
    index = Index.built(codes + 1, words.first)
    letters, bounds = text_bytes(different)
    uri = new_file(folder, ".fm")
    with create(uri) as out:
        out.write(_saved({**index.parts, "first": words.first, "letters": letters, "bounds": bounds,
                          "ids": np.array([i or 0 for i in ids], np.int64), "named": np.array([i is not None for i in ids], bool)}))
    return uri, len(ids), len(codes)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, n_docs, n_words): files of the index of every shard, in the shared folder."""
    folder = scratch_path(docs.sparkSession, "fm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0

        def settle() -> pa.RecordBatch:
            data = np.concatenate([d for d, _ in held])
            ends = np.concatenate([np.zeros(1, np.int64), *[o[1:] + base for (_, o), base in zip(held, np.cumsum([0, *[len(d) for d, _ in held]]))]])
            row = _shard_file(folder, ids, data, ends)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "n_docs", "n_words"])

        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                ids += part.column("doc_id").to_pylist()
                held.append((data, offsets))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield settle()
                    ids, held, size = [], [], 0
        if ids:
            yield settle()

    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(given.mapInArrow(run, "path string, n_docs bigint, n_words bigint"), "fm-shards")[0]


def windows(items: DataFrame, width: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, item): every window of ``width`` words of every item once, words joined by spaces; short items are one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=200_000):
                data, offsets = text_bytes(part.column("text"))
                words = Words(LOWER[data], offsets, ALNUM)
                named = part.column("item").to_pylist()
                found: dict[tuple, None] = {}
                for k, (a, b) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
                    own = [words.data[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])]
                    for j in range(max(len(own) - width, 0) + 1 if own else 0):
                        found[b" ".join(own[j:j + width]), named[k]] = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.binary()).cast(pa.string()), pa.array([i for _, i in found], pa.string())], ["words", "item"])

    given = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, "words string, item string").distinct()


class _Windows:
    """A batch of different windows: their words as numbers of the batch, and the items of each."""

    def __init__(self, batch: pa.RecordBatch):
        coded = batch.column("words").dictionary_encode()
        split = [w.split(" ") for w in coded.dictionary.to_pylist()]
        self.sizes = np.array([len(w) for w in split], np.int64)
        width = int(self.sizes.max(initial=0))
        known: dict[str, int] = {}
        self.numbers = np.full((len(split), width), -1, np.int64)
        for row, words in zip(self.numbers, split):
            row[width - len(words):] = [known.setdefault(w, len(known)) for w in words]
        self.words = pa.array(list(known), pa.string()).cast(pa.large_binary())
        self.items = batch.column("item").to_pylist()
        of = coded.indices.to_numpy(zero_copy_only=False)
        self.order = np.argsort(of, kind="stable")
        self.bounds = np.searchsorted(of[self.order], np.arange(len(split) + 1))


def _found(shard: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, set]:
    """Hits of every word of the shard, as steps up and down, and (document, item) pairs."""
    index = Index(*(shard[c] for c in ("levels", "zeros", "counts", "marked", "samples")))
    first = shard["first"]
    begin = first[:-1] + np.arange(len(first) - 1)  # a closing number stands behind each document
    step, pairs = np.zeros(first[-1] + len(first), np.int64), set()
    different = pa.Array.from_buffers(pa.large_binary(), len(shard["bounds"]) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(shard["bounds"])), pa.py_buffer(np.ascontiguousarray(shard["letters"]))])
    for batch in batches:
        asked = _Windows(batch)
        code = pc.index_in(asked.words, different).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        low, high = index.search(np.append(code, 0)[asked.numbers], asked.sizes)
        n = high - low
        for a, b in _portions(n):
            which = np.repeat(np.arange(a, b), n[a:b])
            rows = np.arange(len(which)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + low[which]
            for k in range(0, len(rows), AT_ONCE):
                place, window = index.locate(rows[k:k + AT_ONCE]), which[k:k + AT_ONCE]
                np.add.at(step, place, 1)
                np.add.at(step, place + asked.sizes[window], -1)
                doc = np.searchsorted(begin, place, side="right") - 1
                for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                    pairs.update((d, asked.items[i]) for i in asked.order[asked.bounds[w]:asked.bounds[w + 1]])
    return step, pairs


def _portions(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows with about ``AT_ONCE`` rows together, one window at least."""
    ends = np.cumsum(n)
    a = int(np.searchsorted(ends, 0, side="right"))
    while a < len(n):
        b = max(int(np.searchsorted(ends, ends[a] - n[a] + AT_ONCE, side="right")), a + 1)
        yield a, b
        a = b


def _shard_rows(shard: dict[str, np.ndarray], batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    step, pairs = _found(shard, batches)
    first = shard["first"]
    docs = len(first) - 1
    inside = np.ones(len(step), bool)
    inside[first[1:] + np.arange(docs)] = False
    hit = (np.cumsum(step) > 0)[inside][:first[-1]]
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    starts = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    of = np.searchsorted(starts, first)
    base = np.repeat(first[:-1], np.diff(of))
    spans = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]))
    items: dict[int, list] = {}
    for doc, item in pairs:
        if item is not None:
            items.setdefault(doc, []).append(item)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard["ids"], mask=~shard["named"]), pa.array(np.diff(first)), spans,
         pa.array([sorted(items.get(d, ()), key=str.encode) for d in range(docs)], pa.list_(pa.string()))],
        ["doc_id", "n_words", "spans", "items"])


def search(shards: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document of the shards.

    ``spans`` are maximal stretches of words (start, end) under any window of
    ``phrases`` (words, item); ``items`` name those with an occurring window.
    """
    files = written(phrases, "windows")[0].inputFiles()

    def batches() -> Iterator[pa.RecordBatch]:
        for name in files:
            with open_file(name) as held:
                yield from (b for b in pq.ParquetFile(held).iter_batches(BATCH, columns=["words", "item"]) if b.num_rows)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for path in batch.column("path").to_pylist():
                with open_file(path) as held, np.load(io.BytesIO(held.read())) as parts:
                    yield _shard_rows(dict(parts), batches())

    return dealt(shards.select("path")).mapInArrow(
        run, "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document against every item."""
    return search(build(docs), windows(items, width))


def without_spans(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The rows with their text cut: from the first byte of a span's first word to the last of its last word."""
    out = rows.schema.names
    ddl = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for whole, own in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist()):
                if whole and own:
                    raw = np.frombuffer(whole.encode(), np.uint8)
                    words = Words(LOWER[raw], np.array([0, len(raw)]), ALNUM)
                    keep = np.ones(len(raw), bool)
                    for span in own:
                        keep[words.starts[span["start"]]:words.ends[span["end"] - 1]] = False
                    whole = raw[keep].tobytes().decode()
                cut.append(whole)
            at = out.index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return rows.mapInArrow(run, ddl)


def hit_digests(found: DataFrame) -> DataFrame:
    """Counts of words, hit words and items, and a digest of the items."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
