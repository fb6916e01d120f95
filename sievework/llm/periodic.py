"""Maximal periodic runs of words in every document, and texts with the repetitions taken out.

Baier's grouping gives the Lyndon arrays: suffixes are grouped by their first
word; groups are taken from the highest to the lowest, each member is tied to
the nearest earlier suffix of a lower group, and suffixes tied to the same
group equally often move together to a new group just above their own, whose
context grows by the words of the group taken.  When a group is taken, its
context is the longest Lyndon word that starts at its members.  This is done
under the order of words and under its reverse: every run has a Lyndon root
that is the longest Lyndon word at its place under one of the two.  Roots that
follow themselves are extended both ways by longest common extensions (prefix
sums of powers under two primes, and each run compared word by word in the
end), which gives each run once, with its smallest period.

Documents are handled as whole word sequences, several in a slice of a task;
nothing is shuffled.  Time is linear in the words but for the logarithm of the
extensions; a task holds some hundred bytes a word of its longest document.

Defined cases: null and empty text have no words, no runs and the empty text
left; rows may repeat and ids may be null; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import slices, text_bytes
from sievework.llm.words import NOT_SPACE, Words

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_TIMES = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a document from which compact arrays replace lists.
LONG = 500_000
_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_103_515_249, 1_812_433_261)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Letters:
    """Different letters of a sequence in ascending order: how often each stands, where, and each place's letter."""

    def __init__(self, codes: np.ndarray):
        order = np.argsort(codes, kind="stable")
        new = np.ones(len(codes), bool)
        np.not_equal(codes[order[1:]], codes[order[:-1]], out=new[1:])
        self.order, self.starts = order, np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(codes)))
        self.letter = np.empty(len(codes), np.int64)
        self.letter[order] = np.cumsum(new) - 1


def lyndon_array(letters: _Letters, falling: bool) -> list:
    """Length of the longest Lyndon word at each place, by grouping; the end of the text is lower than all letters.

    Under ``falling`` the letters count in reverse order.
    """
    n, m = len(letters.letter), len(letters.sizes)
    numbers = (lambda x: array("i", x)) if n > LONG else list
    turn = -1 if falling else 1
    group = numbers((m - 1 - letters.letter if falling else letters.letter).tolist())
    # A group of one place has it as its only one; the places of larger ones are listed beside.
    several = letters.sizes > 1
    more = numbers([0]) * (n + 1)
    only = numbers(np.where(several, -1, letters.order[letters.starts])[::turn].tolist()) + more
    many = {}
    for k in np.flatnonzero(several).tolist():
        at = letters.starts[k]
        many[m - 1 - k if falling else k] = letters.order[at:at + letters.sizes[k]].tolist()
    length, size = numbers([1]) * m + more, numbers(letters.sizes[::turn].tolist()) + more
    down, up = numbers(range(-1, m)) + more, numbers(range(1, m + 2)) + more
    # Places not taken yet, as a list linked both ways; the last cell takes what would lie outside.
    left, right = numbers(range(-1, n)), numbers(range(1, n + 2))
    lyndon = numbers([0]) * n
    new = m + 1  # m stands above all groups
    current = down[m]
    while current >= 0:
        i = only[current]
        if i >= 0:
            if group[i] == current:
                lyndon[i] = long = length[current]
                p = left[i]
                q = right[i]
                right[p] = q
                left[q] = p
                if p >= 0:
                    old = group[p]
                    if size[old] == 1:
                        length[old] += long
                    else:
                        size[old] -= 1
                        above = up[old]
                        group[p] = down[above] = up[old] = new
                        only[new] = p
                        size[new] = 1
                        length[new] = length[old] + long
                        down[new] = old
                        up[new] = above
                        new += 1
        else:
            long = length[current]
            tied: dict[int, int] = {}
            for i in many.pop(current):
                if group[i] == current:
                    lyndon[i] = long
                    p = left[i]
                    q = right[i]
                    right[p] = q
                    left[q] = p
                    if p in tied:
                        tied[p] += 1
                    elif p >= 0:
                        tied[p] = 1
            # A place tied to a member of this group has been taken; only places of lower groups move.
            moves: dict[tuple[int, int], list] = {}
            for p, times in tied.items():
                old = group[p]
                if old != current:
                    if size[old] == 1:
                        length[old] += times * long
                    else:
                        moves.setdefault((times, old), []).append(p)
            for times, old in sorted(moves, reverse=True):
                movers = moves[times, old]
                if size[old] == len(movers):
                    length[old] += times * long
                    continue
                size[old] -= len(movers)
                above = up[old]
                down[above] = up[old] = new
                for p in movers:
                    group[p] = new
                if len(movers) == 1:
                    only[new] = movers[0]
                else:
                    only[new] = -1
                    many[new] = movers
                size[new] = len(movers)
                length[new] = length[old] + times * long
                down[new] = old
                up[new] = above
                new += 1
        current = down[current]
    return lyndon


class _Extensions:
    """Equality and common extensions of stretches of one sequence."""

    def __init__(self, codes: np.ndarray):
        n, self.sums, self.powers = len(codes), [], []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(n + 1, np.uint64)
            done = 1
            while done <= n:
                step = min(done, n + 1 - done)
                power[done:done + step] = power[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                done += step
            term = (codes.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(12345)) % np.uint64(prime) * power[:n] % np.uint64(prime)
            # Terms are below 2**31, so 2**32 of them stay within 64 bits.
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64) % np.uint64(prime)]))
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n letters from a on equal those from b on; a <= b."""
        same = np.ones(len(a), bool)
        for prime, s, power in zip(_PRIMES, self.sums, self.powers):
            p = np.uint64(prime)
            same &= (s[a + n] + p - s[a]) % p * power[b - a] % p == (s[b + n] + p - s[b]) % p
        return same

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Length, at most ``most``, of what follows (or ends before) a and b alike."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while len(a) and (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a - half, b - half, half) if back else self.equal(a, b, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def runs_of(codes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """All runs of several sequences laid behind each other: columns (start, end, period), ordered.

    ``first`` holds the place of each sequence's first letter, and the end.
    Roots are looked for that stand twice behind each other, which every run of
    three periods has.
    """
    if min_times < 3:
        raise ValueError("runs of fewer than three periods need not hold a root twice")
    codes, first, shift = _stretches(codes, first, min_words)
    n = len(codes)
    roots = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        letters = _Letters(codes[a:b])
        roots[0][a:b] = lyndon_array(letters, False)
        roots[1][a:b] = lyndon_array(letters, True)
    end_of = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    found = []
    for k, period in enumerate(roots):
        here = np.flatnonzero((period > 0) & (at + 2 * period <= end_of) & ((period != roots[0]) if k else True))
        for step in (0, 1, 2):
            ahead = np.minimum(step, period[here] - 1)
            here = here[codes[here + ahead] == codes[here + ahead + period[here]]]
        found.append(np.stack([here, period[here]]))
    place, period = np.concatenate(found, axis=1)
    if not len(place):
        return np.empty((0, 3), np.int64)
    # Stretches without such a root are done.
    of = np.searchsorted(first, place, side="right") - 1
    held = np.zeros(len(first) - 1, bool)
    held[of] = True
    sizes = np.where(held, np.diff(first), 0)
    codes = codes[np.repeat(held, np.diff(first))]
    moved = np.concatenate([[0], np.cumsum(sizes)])
    back = first - moved
    runs = _extended(codes, moved, place - back[of], period, min_words, min_times)
    of = np.searchsorted(moved, runs[:, 0], side="right") - 1
    runs[:, :2] += (back[of] + shift[of])[:, None]
    return runs


def _stretches(codes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences cut at letters that stand once in theirs, which no run can hold: codes, bounds, and the way back.

    Stretches of fewer than ``least`` letters are left out.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = owner * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key)
    equal = np.diff(key[order]) == 0
    again = np.zeros(len(codes), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    at = np.flatnonzero(again)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(at)))
    long = sizes >= least
    kept = at[np.repeat(long, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes[long])])
    return codes[kept], bounds, np.append(at[heads[long]], 0) - bounds


def _extended(codes: np.ndarray, first: np.ndarray, place: np.ndarray, period: np.ndarray, min_words: int, min_times: int) -> np.ndarray:
    """Runs (start, end, period) of the roots at ``place`` that stand twice behind each other."""
    n = len(codes)
    start_of = np.repeat(first[:-1], np.diff(first))
    end_of = np.repeat(first[1:], np.diff(first))
    reach = _Extensions(codes)
    twice = reach.equal(place, place + period, period)
    place, period = place[twice], period[twice]
    # Of the roots of one run that follow each other the first is enough.
    key = place * (n + 1) + period
    known = np.sort(key)
    before = (place - period) * (n + 1) + period
    later = (place - period >= start_of[place]) & (known[np.minimum(np.searchsorted(known, before), len(known) - 1)] == before if len(known) else False)
    place, period = place[~later], period[~later]
    ahead = reach.common(place, place + period, end_of[place] - place - period, False)
    behind = reach.common(place, place + period, place - start_of[place], True)
    start, end = place - behind, place + period + ahead
    wanted = end - start >= np.maximum(min_words, min_times * period)
    runs = np.unique(np.stack([start, period, end])[:, wanted], axis=1).T
    for s, q, e in runs.tolist():
        if not np.array_equal(codes[s:e - q], codes[s + q:e]):
            raise RuntimeError("two stretches of words share their sums under both primes")
    return runs[:, [0, 2, 1]]


def _kept(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def _joined(words: Words, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    size = np.where(keep, words.ends - words.starts + 1, 0)
    place = np.concatenate([[0], np.cumsum(size)])
    # A kept word and one byte behind it; the byte becomes the space, and the last one of a text goes.
    starts, sizes = words.starts[keep], size[keep]
    out = np.full(place[-1], 32, np.uint8)
    inner = np.ones(place[-1], bool)
    inner[np.cumsum(sizes) - 1] = False
    mask = np.zeros(len(words.data) + 1, np.int8)
    mask[starts] += 1
    np.add.at(mask, words.ends[keep], -1)
    out[inner] = words.data[np.cumsum(mask[:-1]).astype(bool)]
    bounds = place[first]
    last = np.diff(bounds) > 0
    out = np.delete(out, bounds[1:][last] - 1)
    offsets = bounds - np.concatenate([[0], np.cumsum(last)])
    return pa.Array.from_buffers(
        pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])


def _rows(batches: Iterator[pa.RecordBatch], min_words: int, min_times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=4_000_000):
            words = Words(*text_bytes(part.column("text")), NOT_SPACE)
            codes, _ = words.codes()
            first = words.first
            runs = runs_of(codes, first, min_words, min_times)
            of = np.searchsorted(runs[:, 0], first)
            base = np.repeat(first[:-1], np.diff(of))
            listed = pa.ListArray.from_arrays(
                pa.array(of.astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(runs[:, 0] - base), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                                           fields=list(_RUNS.value_type)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first)), listed, _joined(words, _kept(runs, len(codes)), first).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` are (start, length, period) in words, ordered by start and period;
    ``collapsed`` is the text without the words that a run repeats.
    """
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(
        lambda batches: _rows(batches, min_words, min_times),
        "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_periodic_ends(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the texts, by crc32 of the id, turn periodic from some word on."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    h = F.crc32(name)
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         h.alias("h"), g.alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words.cast("array<string>"))).withColumn("n", F.size("words").cast("bigint"))
    a = F.col("g") % F.col("n")
    p = F.lit(1) + F.floor((F.col("n") - a) / (F.lit(3) + F.col("g") % 8)).cast("bigint")
    changed = chosen.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    cell = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    turned = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), cell), " ")
    return changed.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    whole = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(whole.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
