"""Best-fit packing of documents into sequences of a fixed number of tokens.

Linear grouping: the large pieces, sorted by length, are cut into groups of
equal cardinality and rounded up to their group's largest length.  For these
few sizes the best fillings of a sequence (configurations) are found by column
generation: a linear program over configurations whose next column is a
knapsack.  Whole multiples of each configuration are kept, the actual
documents take the places of their rounded lengths, and everything left over,
the small pieces first of all, is best-fitted into the remaining room.

All of this works on the count of pieces per length, at most ``capacity``
numbers whatever the size of the corpus.  The result is a short table of runs
("the pieces of length 310 with ranks 5000 to 8999 go to sequences 120000 to
123999 at offset 512"); each piece finds its place by its rank among the
pieces of its length.  Ranks are counted in each task while it encodes, and
joined with the counts of earlier tasks: nothing is gathered, and no group of
equal lengths ever meets in one task.

Defined cases: null text is empty and gives one piece holding the end id; only
texts of more than ``capacity`` ids are cut, the first piece taking the odd
rest; repeated rows are packed as documents of their own; an empty table gives
no pieces; other columns are ignored.
"""

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import slices, written
from sievework.llm.tokens import IdEncoder

CAPACITY = 1024
END_ID = 2
#: Groups of large lengths and the length that counts as large (share of the capacity): each pair is tried.
TRIALS = ((48, 0.125), (96, 0.25), (32, 0.5))
MAX_COLUMNS = 600

Run = tuple[int, tuple[int, ...]]  # so many sequences, each with pieces of these lengths


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]) of every piece; rank counts equal lengths in its task."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
             ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = IdEncoder.of_worker(tokenizer, end_id), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, limit=2_000_000):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows: list[tuple] = []
                for name, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(texts)):
                    total = len(ids) // 4
                    head = total % capacity or capacity
                    cuts = [0, *range(head, total + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a:4 * b]
                        rows.append((name, k, a, b - a, zlib.crc32(own), part, int(ranks[b - a]), *([own] * with_ids)))
                        ranks[b - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the filling of a sequence of the greatest value."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    ordered, worth = sizes[order], value[order]
    for room in range(int(ordered[0]), capacity + 1):
        fit = int(np.searchsorted(ordered, room, side="right"))
        options = best[room - ordered[:fit]] + worth[:fit]
        k = int(np.argmax(options))
        if options[k] > best[room - 1]:
            best[room], item[room] = options[k], k
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if item[room] < 0 or best[room] == best[room - 1]:
            room -= 1
            continue
        out[order[item[room]]] += 1
        room -= int(ordered[item[room]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """(multiplicity, pieces of each size) of the linear program's optimum, by column generation."""
    columns = np.diag(capacity // sizes).astype(float)
    basis = np.diag(1 / np.diag(columns))  # inverse of the basic columns
    amount = basis @ demand
    for _ in range(MAX_COLUMNS):
        worth, column = _best_configuration(sizes, basis.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        entering = basis @ column
        ratio = np.where(entering > 1e-9, amount / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(np.argmin(ratio))
        step, pivot = ratio[out], basis[out] / entering[out]
        amount = amount - step * entering
        basis = basis - np.outer(entering, pivot)
        basis[out], amount[out], columns[:, out] = pivot, step, column
    return [(float(max(a, 0)), columns[:, k].astype(np.int64)) for k, a in enumerate(amount)]


def _substitute(counts: np.ndarray, groups: int, least: int, capacity: int) -> tuple[list[Run], np.ndarray]:
    """Runs of configurations filled with actual lengths, and the counts still to be placed."""
    left = counts.copy()
    large = [n for n in range(capacity, least - 1, -1) if counts[n]]
    total = int(counts[least:].sum())
    if not total:
        return [], left
    # Groups of equal cardinality: (rounded size, [(length, pieces)]).
    quota, grouped, room = -(-total // groups), [], 0
    for length in large:
        n = int(counts[length])
        while n:
            if room == 0:
                grouped.append([])
                room = quota
            take = min(n, room)
            grouped[-1].append((length, take))
            n, room = n - take, room - take
    demand: dict[int, int] = defaultdict(int)
    stock: dict[int, list[list[int]]] = defaultdict(list)
    for group in grouped:
        size = group[0][0]
        demand[size] += sum(n for _, n in group)
        stock[size] += [[length, n] for length, n in group]
    sizes = np.array(sorted(demand), np.int64)
    wanted = np.array([demand[s] for s in sizes], float)
    runs: list[Run] = []
    for multiple, column in configurations(sizes, wanted, capacity):
        bins = int(multiple + 1e-6)
        bins = min([bins, *(sum(n for _, n in stock[s]) // int(c) for s, c in zip(sizes, column) if c)])
        if bins <= 0 or not column.any():
            continue
        slots = []  # for each place in the sequence, the actual lengths of its ``bins`` pieces
        for size, places in zip(sizes.tolist(), column.tolist()):
            for _ in range(places):
                need, own = bins, []
                while need:
                    length, n = stock[size][0]
                    take = min(need, n)
                    own.append([length, take])
                    left[length] -= take
                    need -= take
                    stock[size][0][1] -= take
                    if not stock[size][0][1]:
                        stock[size].pop(0)
                slots.append(own)
        while slots[0]:
            step = min(own[0][1] for own in slots)
            runs.append((step, tuple(own[0][0] for own in slots)))
            for own in slots:
                own[0][1] -= step
                if not own[0][1]:
                    own.pop(0)
    return runs, left


def _best_fit(runs: list[Run], left: np.ndarray, capacity: int) -> list[Run]:
    """Put the remaining pieces, longest first, where they leave the least room; whole runs at a time."""
    rooms: dict[int, list[Run]] = defaultdict(list)
    for n, lengths in runs:
        rooms[capacity - sum(lengths)].append((n, lengths))
    order = sorted(rooms)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                bins, lengths = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room, bins, lengths = capacity, n, ()
            each = min(room // length, n)
            filled = min(bins, n // each)
            if at < len(order) or lengths:
                if bins > filled:
                    if not rooms[room]:
                        insort(order, room)
                    rooms[room].append((bins - filled, lengths))
            rest = room - each * length
            if not rooms[rest]:
                insort(order, rest)
            rooms[rest].append((filled, lengths + (length,) * each))
            n -= filled * each
    return [run for room in sorted(rooms) for run in rooms[room]]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences that hold ``counts[n]`` pieces of every length n; the best of the groupings tried."""
    tried = [_best_fit(*_substitute(counts, groups, max(1, int(capacity * share)), capacity), capacity) for groups, share in TRIALS]
    return min(tried, key=lambda runs: sum(n for n, _ in runs))


def places(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (length, first rank, first sequence, offset), sorted by length and rank."""
    given: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append((length, given[length], sequence, offset))
            given[length] += n
            offset += length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    cut, _ = written(pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids), "pieces")
    counts, _ = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    length, rank, sequence, offset = places(plan(histogram, capacity))
    key = length * (1 << 40) + rank

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(key, lengths.to_numpy() * (1 << 40) + ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[k] + ranks.to_numpy() - rank[k], "offset": offset[k]})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("place", placed("length", F.col("rank") + F.col("base")))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*shown, "place.sequence_id", "place.offset", *(["ids"] if with_ids else []))
