"""Token ids in files, packed by an adaptive context-mixing range coder.

A file holds segments, a segment blocks of ``BLOCK`` ids.  Each block is coded
on its own: its models start anew and its ids carry a checksum.  Three
predictions are mixed for every id.  Order 2 and order 1 each propose the id
that last followed the same context, weighted by how often proposals of that
confidence held so far in the block; order 0 covers all ids, by adaptive counts
of 64 classes of ids and the frequencies within a class, which the segment's
header gives.  The mixed distribution is one interval per proposal and the rest
for order 0, and drives a carry-less 48-bit range coder.

All blocks of a segment are coded in lockstep, one id of each at a time, so the
coder runs on vectors; the decoder is the same model fed from the file.

Defined cases: null text is empty and gives the end id alone; repeated rows are
documents of their own; a null id comes first; documents with equal ids are in
order of the hash of their texts; ids of 65536 and more are refused; an empty
table gives no rows; other columns are ignored.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.files import create, new_file, open_file
from sievework.llm.shared import dealt, scratch_path, slices, written
from sievework.llm.tokens import IdEncoder

END_ID = 1
#: Ids of a block, and blocks of a segment.
BLOCK, SEGMENT_BLOCKS = 512, 16384
CLASSES, STEP = 64, 24
_MAGIC, _HEAD = b"SWIDS1\n\0", "<8sQQQIIII"
_BITS1, _BITS2 = 8, 9
_SCALE = 1 << 18
_MASK = (1 << 48) - 1


#: What an id of each class adds to the running counts of all classes.
_ADDED = (np.arange(CLASSES + 1) > np.arange(CLASSES)[:, None]).astype(np.uint16) * np.uint16(STEP)
_ONE, _WORD, _TWO_WORDS, _MASK48 = np.uint64(1), np.uint64(16), np.uint64(32), np.uint64(_MASK)
_SHORT, _CUT, _LOW32, _LOW16 = np.uint64(1 << 20), np.uint64(1 << 32), np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)


class _Order0:
    """Frequencies of ids in a segment, cut into classes of about equal weight."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequency)]).astype(np.uint64)
        total = int(self.start[-1])
        self.of = np.minimum(self.start[:-1].astype(np.int64) * CLASSES // max(total, 1), CLASSES - 1)
        first = np.searchsorted(self.of, np.arange(CLASSES + 1))
        self.base = self.start[first[:-1]]
        self.total = np.maximum(self.start[first[1:]] - self.base, 1).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(frequency), dtype=np.uint16), frequency)


class _Models:
    """State of all lanes: proposals of order 1 and 2, their hit rates, class counts."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.tables = [np.zeros(lanes << _BITS1, np.uint32), np.zeros(lanes << _BITS2, np.uint32)]
        self.rates = [np.full(lanes * 4, 1 << 15, np.int64), np.full(lanes * 4, 1 << 15, np.int64)]
        self.counts = np.tile(np.arange(CLASSES + 1, dtype=np.uint16) * 8, (lanes, 1))
        self.last = np.zeros(lanes, np.uint32)
        self.before = np.zeros(lanes, np.uint32)

    def propose(self, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id of order 1, its width, id of order 2, its width) of the first ``lanes`` lanes; widths of 65536."""
        lane, last = self.lane[:lanes], self.last[:lanes]
        one = (last * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS1)
        two = ((last * np.uint32(0x85EBCA77)) ^ (self.before[:lanes] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - _BITS2)
        self.at = [(lane << _BITS1) + one, (lane << _BITS2) + two]
        self.entries = [table[at] for table, at in zip(self.tables, self.at)]
        self.proposed = [e & np.uint32(0xFFFF) for e in self.entries]
        self.trust = [(e >> np.uint32(16)).astype(np.int64) for e in self.entries]
        self.rate_at = [lane * 4 + t for t in self.trust]
        rate = [r[at] for r, at in zip(self.rates, self.rate_at)]
        width2 = np.where(self.trust[1] > 0, rate[1], 0)
        width1 = (65536 - width2) * rate[0] >> 16
        width1[(self.trust[0] == 0) | ((self.proposed[0] == self.proposed[1]) & (width2 > 0))] = 0
        return self.proposed[0], width1, self.proposed[1], width2

    def learn(self, ids: np.ndarray) -> None:
        lanes = len(ids)
        for table, at, entry, proposed, trust, rates, rate_at in zip(
                self.tables, self.at, self.entries, self.proposed, self.trust, self.rates, self.rate_at):
            hit = (proposed == ids) & (trust > 0)
            rate = rates[rate_at]
            rates[rate_at] = np.minimum(np.maximum(rate + ((np.where(hit, 65536, 0) - rate) >> 5), 512), 60000)
            more = np.where(hit, np.minimum(trust + 1, 3), trust - 1).astype(np.uint32)
            table[at] = np.where(hit | (trust > 1), proposed | more << np.uint32(16), ids | np.uint32(1 << 16))
        self.before[:lanes] = self.last[:lanes]
        self.last[:lanes] = ids

    def count(self, rows: np.ndarray, classes: np.ndarray) -> None:
        self.counts[rows] += _ADDED[classes]


class _Coder:
    """Range coder on lanes; ``words`` is written by an encoder and read by a decoder."""

    def __init__(self, lanes: int, words: np.ndarray, decode: bool = False):
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, _MASK, np.uint64)
        self.words, self.at, self.decode = words, np.zeros(lanes, np.int64), decode
        self.code = np.zeros(lanes, np.uint64)
        if decode:
            for _ in range(3):
                self.code = self.code << _WORD | words[np.arange(lanes), self.at]
                self.at += 1

    def _unit(self, rows: np.ndarray | slice, total: np.ndarray | None) -> np.ndarray:
        """Width of one of ``total`` parts of the interval (of 65536 if not given)."""
        return self.width[rows] >> _WORD if total is None else self.width[rows] // total

    def target(self, rows: np.ndarray | slice, total: np.ndarray | None = None) -> np.ndarray:
        self.unit = self._unit(rows, total)
        return np.minimum((self.code[rows] - self.low[rows]) // self.unit, _LOW16 if total is None else total - _ONE)

    def step(self, rows: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.ndarray | None = None) -> None:
        """Narrow the intervals of ``rows`` (a slice: the first lanes) and move settled words."""
        unit = self.unit if self.decode else self._unit(rows, total)
        low, width = self.low[rows] + start * unit, size * unit
        self.low[rows], self.width[rows] = low, width
        first = isinstance(rows, slice)
        while True:
            same = (low ^ (low + width)) < _CUT
            short = width < _SHORT
            short &= ~same
            if short.any():  # cut the interval at the next multiple of 2**32, so that its first word is settled
                width = np.where(short, _CUT - (low & _LOW32), width)
                self.width[rows] = width
                same |= short
            picked = np.flatnonzero(same)
            if not len(picked):
                return
            rows, low, width = picked if first else rows[picked], low[picked], width[picked]
            first, at = False, self.at[rows]
            if self.decode:
                self.code[rows] = (self.code[rows] << _WORD & _MASK48) | self.words[rows, at]
            else:
                self.words[rows, at] = low >> _TWO_WORDS
            self.at[rows] = at + 1
            low, width = low << _WORD & _MASK48, width << _WORD
            self.low[rows], self.width[rows] = low, width

    def finish(self) -> None:
        lanes = np.arange(len(self.low))
        for k in (_TWO_WORDS, _WORD, np.uint64(0)):
            self.words[lanes, self.at] = self.low >> k & _LOW16
            self.at += 1


def encode_blocks(ids: np.ndarray, order0: _Order0) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks behind each other, words of each block) of a segment's ids."""
    lanes = -(-len(ids) // BLOCK)
    grid = np.zeros(lanes * BLOCK, np.uint16)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    models = _Models(lanes)
    coder = _Coder(lanes, np.zeros((lanes, BLOCK * 4 + 8), np.uint16))
    full, rest = lanes - 1, len(ids) - (lanes - 1) * BLOCK
    for k in range(BLOCK):
        n = lanes if k < rest else full
        if n == 0:
            break
        own, rows = grid[k, :n].astype(np.uint32), slice(0, n)
        one, width1, two, width2 = models.propose(n)
        hit2 = (own == two) & (width2 > 0)
        hit1 = ~hit2 & (own == one) & (width1 > 0)
        miss = ~(hit2 | hit1)
        start = np.where(hit2, 0, np.where(hit1, width2, width2 + width1)).astype(np.uint64)
        size = np.where(hit2, width2, np.where(hit1, width1, 65536 - width2 - width1)).astype(np.uint64)
        coder.step(rows, start, size)
        open_rows = np.flatnonzero(miss)
        if len(open_rows):
            own_ids = own[open_rows].astype(np.int64)
            kind = order0.of[own_ids]
            counts = models.counts
            low = counts[open_rows, kind].astype(np.uint64)
            coder.step(open_rows, low, counts[open_rows, kind + 1] - low, counts[open_rows, CLASSES].astype(np.uint64))
            models.count(open_rows, kind)
            coder.step(open_rows, order0.start[own_ids] - order0.base[kind], order0.frequency[own_ids], order0.total[kind])
        models.learn(own)
    coder.finish()
    used = coder.at
    return np.concatenate([coder.words[k, :used[k]] for k in range(lanes)]), used.astype(np.uint32)


def decode_blocks(words: np.ndarray, used: np.ndarray, n_ids: int, order0: _Order0) -> np.ndarray:
    """The ids of a segment."""
    lanes = len(used)
    ends = np.cumsum(used.astype(np.int64))
    grid = np.zeros((lanes, int(used.max(initial=0)) + 8), np.uint16)
    for k in range(lanes):
        grid[k, :used[k]] = words[ends[k] - used[k]:ends[k]]
    out = np.zeros((BLOCK, lanes), np.uint16)
    models, coder = _Models(lanes), _Coder(lanes, grid, True)
    full, rest = lanes - 1, n_ids - (lanes - 1) * BLOCK
    for k in range(BLOCK):
        n = lanes if k < rest else full
        if n == 0:
            break
        rows = slice(0, n)
        one, width1, two, width2 = models.propose(n)
        target = coder.target(rows).astype(np.int64)
        hit2 = target < width2
        hit1 = ~hit2 & (target < width2 + width1)
        start = np.where(hit2, 0, np.where(hit1, width2, width2 + width1)).astype(np.uint64)
        size = np.where(hit2, width2, np.where(hit1, width1, 65536 - width2 - width1)).astype(np.uint64)
        coder.step(rows, start, size)
        ids = np.where(hit2, two, one)
        open_rows = np.flatnonzero(~(hit2 | hit1))
        if len(open_rows):
            counts = models.counts[open_rows]
            total = counts[:, CLASSES].astype(np.uint64)
            kind = (counts > coder.target(open_rows, total).astype(np.uint16)[:, None]).argmax(axis=1) - 1
            picked = np.arange(len(open_rows))
            low = counts[picked, kind].astype(np.uint64)
            coder.step(open_rows, low, counts[picked, kind + 1] - low, total)
            models.count(open_rows, kind)
            slot = coder.target(open_rows, order0.total[kind]) + order0.base[kind]
            found = order0.slot[slot.astype(np.int64)].astype(np.int64)
            coder.step(open_rows, order0.start[found] - order0.base[kind], order0.frequency[found], order0.total[kind])
            ids[open_rows] = found
        out[k, :n] = ids
        models.learn(ids)
    return out.T.reshape(-1)[:n_ids]


def write_segment(out, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
    """Append a segment: header, documents, frequencies, block sizes and checksums, blocks."""
    count = np.bincount(ids, minlength=1 << 16)
    frequency = np.where(count > 0, np.maximum(1, count * _SCALE // max(len(ids), 1)), 0)
    words, used = encode_blocks(ids, _Order0(frequency))
    sums = np.array([zlib.crc32(ids[k:k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(ids), BLOCK)], "<u4")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    documents = zlib.compress(names.tobytes() + np.array(lengths, "<i8").tobytes() + known.tobytes())
    table = zlib.compress(frequency.astype("<u4").tobytes())
    index = used.astype("<u4").tobytes() + sums.tobytes()
    out.write(struct.pack(_HEAD, _MAGIC, len(doc_ids), len(ids), len(words), len(documents), len(table), BLOCK, zlib.crc32(documents + table + index)))
    for part in (documents, table, index, words.astype("<u2").tobytes()):
        out.write(part)


def read_segments(uri: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, lengths, token ids) of every segment; a checksum that does not agree fails."""
    with open_file(uri) as file:
        while head := file.read(struct.calcsize(_HEAD)):
            magic, n_docs, n_ids, n_words, size_docs, size_table, block, check = struct.unpack(_HEAD, head)
            if magic != _MAGIC or block != BLOCK:
                raise ValueError(f"{uri} is no file of token ids")
            blocks = -(-n_ids // BLOCK)
            documents, table, index = file.read(size_docs), file.read(size_table), file.read(8 * blocks)
            words = np.frombuffer(file.read(2 * n_words), "<u2")
            if zlib.crc32(documents + table + index) != check:
                raise ValueError(f"{uri}: a header is damaged")
            used, sums = np.frombuffer(index, "<u4", blocks), np.frombuffer(index, "<u4", blocks, 4 * blocks)
            raw = zlib.decompress(documents)
            names, lengths = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, "<i8", n_docs, 8 * n_docs)
            known = np.frombuffer(raw, np.uint8, n_docs, 16 * n_docs)
            ids = decode_blocks(words, used, n_ids, _Order0(np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64)))
            for k in range(blocks):
                if zlib.crc32(ids[k * BLOCK:(k + 1) * BLOCK].astype("<u4").tobytes()) != sums[k]:
                    raise ValueError(f"{uri}: block {k} is damaged")
            yield [n if f else None for n, f in zip(names.tolist(), known)], lengths, ids


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending order of doc_id, a file per task; (part, path, n_ids), already written."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "mark", F.xxhash64("text"))
    ordered = given.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, path, out = IdEncoder.of_worker(tokenizer, end_id), new_file(folder, ".ids"), None
        names, lengths, held, size, total = [], [], [], 0, 0

        def flush() -> None:
            nonlocal out, size, total
            out = out or create(path)
            ids = np.frombuffer(b"".join(held), "<u4")
            if ids.max(initial=0) >= 1 << 16:
                raise ValueError("ids of 65536 and more do not fit this file format")
            write_segment(out, names, lengths, ids.astype(np.uint16))
            total += len(ids)
            size = 0
            for part in (names, lengths, held):
                part.clear()

        for batch in batches:
            for piece in slices(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for name, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts)):
                    names.append(name)
                    lengths.append(len(ids) // 4)
                    held.append(ids)
                    size += len(ids) // 4
                if size >= BLOCK * SEGMENT_BLOCKS:
                    flush()
        if names:
            flush()
        if out:
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([total])], ["part", "path", "n_ids"])

    return written(ordered.mapInArrow(run, "part int, path string, n_ids bigint"), "id-files")[0]


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the files."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    based = dealt(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                for names, lengths, ids in read_segments(path):
                    rows, raw, at = [], ids.astype("<u4").tobytes(), 0
                    for name, n in zip(names, lengths.tolist()):
                        own = raw[4 * at:4 * (at + n)]
                        rows.append((name, start, n, zlib.crc32(own), *([own] * with_ids)))
                        at += n
                        start += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    return based.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What is read back from the files written from the documents."""
    folder = scratch_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, tokenizer, folder), with_ids=False)
