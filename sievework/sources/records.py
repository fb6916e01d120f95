"""Lines of one record joined as they are read.

Lines stand in order inside an input split.  A first scan tells for every
split how it ends and where its records begin, for a split that starts outside
a quoted cell and for one that starts inside; which of the two holds follows on
the table of splits.  A second scan joins the lines of whole records where they
stand, so nothing is shuffled or written but the few records that run from one
split into another.

The table of splits is gathered on the driver: one small row for each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions travel to the tasks by value; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Split(NamedTuple):
    """Where a split stands: lines before it, is a cell open at its start, lines at its head and from ``tail`` on that belong to
    records of several splits, and the first line of a record never closed, if the file has one."""
    before: int
    opened: bool
    head: int
    tail: int | None
    unclosed: int | None


def open_at_start(after0: np.ndarray, after1: np.ndarray, opened: bool) -> tuple[np.ndarray, bool]:
    """Is a cell open at the start of each line, and after the last; each line fixes the answer, keeps it or flips it."""
    flips = np.cumsum(after0 & ~after1)
    last = np.maximum.accumulate(np.where(after0 == after1, np.arange(len(after0)), -1))
    fixed = last >= 0
    after = np.where(fixed, after0[last], opened) ^ ((flips - np.where(fixed, flips[last], 0)) % 2 == 1)
    return np.concatenate([[opened], after[:-1]]), bool(after[-1])


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch cut where the input split changes."""
    if not batch.num_rows:
        return
    files = batch.column("file_id").dictionary_encode()
    code, start = files.indices.to_numpy(zero_copy_only=False), batch.column("block_start").to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield (files.dictionary[int(code[a])].as_py(), int(start[a])), batch.slice(a, b - a)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(name).to_numpy(zero_copy_only=False).astype(bool) for name in ("a0", "a1"))


_ENDS = "file_id string, block_start bigint, first_id bigint, n bigint, out0 boolean, out1 boolean, head0 bigint, head1 bigint, last0 bigint, last1 bigint"


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and for either start: its state at the end, lines before its first record and the place of its last one (-1: none)."""
    key, held = None, None

    def row() -> pa.RecordBatch:
        n = held["n"]
        values = [*key, held["first_id"], n, *held["state"], *(n if h < 0 else h for h in held["head"]), *held["last"]]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [c.split()[0] for c in _ENDS.split(", ")])

    for batch in batches:
        for own, part in runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, held = own, {"first_id": part.column("line_id")[0].as_py(), "n": 0, "state": [False, True], "head": [-1, -1], "last": [-1, -1]}
            after0, after1 = _flags(part)
            for h in (0, 1):
                inside, held["state"][h] = open_at_start(after0, after1, held["state"][h])
                begins = np.flatnonzero(~inside)
                if len(begins):
                    held["last"][h] = held["n"] + int(begins[-1])
                    if held["head"][h] < 0:
                        held["head"][h] = held["n"] + int(begins[0])
            held["n"] += part.num_rows
    if key is not None:
        yield row()


def settled(ends: list) -> dict[tuple[str, int], Split]:
    """Every split's place and start, from the ends of all splits of the files."""
    found: dict[tuple[str, int], Split] = {}
    files: dict[str, list] = {}
    for r in ends:
        files.setdefault(r["file_id"], []).append(r)
    for name, splits in files.items():
        before, state, record, own = 0, False, None, []
        for r in sorted(splits, key=lambda r: r["block_start"]):
            opened, head, last = state, r["head1" if state else "head0"], r["last1" if state else "last0"]
            state = r["out1" if opened else "out0"]
            record = before + last + 1 if last >= 0 else record
            own.append((r["block_start"], before, opened, head, last if state and last >= 0 else None))
            before += r["n"]
        for start, lines, opened, head, tail in own:
            # Lines of a record that is never closed stay rows of their own.
            if state and tail is not None and lines + tail + 1 == record:
                tail = None
            if state and lines >= record:
                head = 0
            found[name, start] = Split(lines, opened, head if opened else 0, tail, record if state else None)
    return found


def joined_in_scan(lines: DataFrame) -> DataFrame:
    """(file_id, row_no, value) of records: their lines joined by line feeds, ``row_no`` the first of them.

    ``lines``: (file_id, block_start, line_id, value, a0, a1) straight from a
    scan, in the order of the files; a0 and a1 tell whether a quoted cell is
    open after the line, if none / one was open before it.  Lines of a record
    still open at the end of its file stay rows of their own.
    """
    spark = lines.sparkSession
    ends = lines.select("file_id", "block_start", "line_id", "a0", "a1").mapInArrow(_split_ends, _ENDS).collect()
    places = settled(ends)
    shared = spark.sparkContext.broadcast({k: tuple(p) for k, p in places.items()})  # classes do not travel in broadcasts

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        held: list[pa.Array] = []  # lines of the record that may go on, and its first row
        first = done = 0

        def record() -> pa.RecordBatch:
            whole = pa.concat_arrays(held)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), b"\n")
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([first], pa.int64()), text], ["file_id", "row_no", "value"])

        for batch in batches:
            for own, part in runs(batch):
                if own != key:
                    if held:
                        yield record()
                    key, held, done = own, [], 0
                    before, state, head, tail, unclosed = shared.value[own]
                inside, state = open_at_start(*_flags(part), state)
                number = np.arange(done, done + part.num_rows)
                if unclosed is not None:
                    inside = inside & (number + before + 1 < unclosed)
                kept = number >= head
                if tail is not None:
                    kept &= number < tail
                done += part.num_rows
                inside, number, values = inside[kept], number[kept], part.column("value").filter(pa.array(kept))
                begins = np.flatnonzero(~inside)
                if not len(begins):
                    held = [*held, values] if len(values) else held
                    continue
                if held:
                    held.append(values[:int(begins[0])])
                    yield record()
                # The last record may go on in the next batch.
                cuts, last = begins.astype(np.int32), int(begins[-1])
                if len(cuts) > 1:
                    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), values[:last]), b"\n")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * len(text)), pa.array(number[begins[:-1]] + before + 1), text], ["file_id", "row_no", "value"])
                held, first = [values[last:]], int(number[last]) + before + 1
        if held:
            yield record()

    text = F.col("value").cast("binary").alias("value")
    whole = lines.select("file_id", "block_start", text, "a0", "a1").mapInArrow(join, "file_id string, row_no bigint, value binary")
    cut = [(r["file_id"], r["block_start"], r["first_id"], p.before, p.head, p.tail) for r in ends
           if (p := places[r["file_id"], r["block_start"]]).head or p.tail is not None]
    if not cut:
        return whole.withColumn("value", F.col("value").cast("string"))
    # The first line of the record that a split starts in.
    carried, begun = {}, {}
    for name, start, _, before, head, tail in sorted(cut, key=lambda c: c[:2]):
        carried[name, start] = begun.get(name)
        begun[name] = before + tail + 1 if tail is not None else begun.get(name)
    rows = [(*c, carried[c[:2]]) for c in cut]
    splits = F.broadcast(spark.createDataFrame(
        rows, "file_id string, block_start bigint, first_id bigint, before bigint, head bigint, tail bigint, carried bigint"))
    place = F.col("line_id") - F.col("first_id")
    pieces = lines.select("file_id", "block_start", "line_id", text).join(splits, ["file_id", "block_start"]).filter(
        (place < F.col("head")) | (place >= F.col("tail")))
    start = F.when(place < F.col("head"), F.col("carried")).otherwise(F.col("before") + F.col("tail") + 1)
    parts = F.array_sort(F.collect_list(F.struct((F.col("before") + place).alias("at"), F.col("value").cast("string").alias("value"))))
    mended = pieces.groupBy("file_id", start.alias("row_no")).agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return whole.withColumn("value", F.col("value").cast("string")).unionByName(mended)
