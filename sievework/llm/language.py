"""Language identification by prediction by partial matching.

For every language a byte context tree of order 0 to 3 is counted over all its
training texts.  A text's code length under a language is exact: at each byte
the longest known context predicts it, or escapes to the next shorter one
(method C: as many escapes as the context has different followers), down to
256 equally likely bytes.  The statistics are frozen after training, so every
(context, byte) has one cost per language; a text's strings of four bytes are
looked up once for each different one in a batch.  The shortest code wins.

Counts are aggregated in the tasks and by Spark.  All counted contexts of all
256 byte values are kept, in sorted arrays of each language's own; what is
gathered grows with the different strings of four bytes, not with the text.

Defined cases: null text and text without a letter are ``und`` with score 0;
without training texts everything is; ties go to the first name in order; a
NUL byte carries no code; rows may repeat; other columns are ignored.
"""

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import fold, slices, text_bytes, written

ORDER = 3
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ORDER zero bytes before each, and the place of each text's first byte."""
    n = len(offsets) - 1
    starts = offsets[:-1] + ORDER * np.arange(1, n + 1)
    out = np.zeros(len(data) + ORDER * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))] = data
    return out, starts


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a task: code is the byte and the three before it."""
    held: dict[str, list] = {}

    def settle(lang: str) -> None:
        codes, n = (np.concatenate(c) for c in zip(*held[lang]))
        codes, place = np.unique(codes, return_inverse=True)
        held[lang] = [(codes, np.bincount(place, n).astype(np.int64))]

    for batch in batches:
        for part in slices(batch):
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                own = part.filter(pa.array([x == lang for x in langs]))
                text, _ = _padded(*text_bytes(own.column("text")))
                if len(text) <= ORDER:
                    continue
                codes = np.ndarray((len(text) - ORDER,), ">u4", np.ascontiguousarray(text), strides=(1,)).astype(np.uint32)
                codes, n = np.unique(codes[(codes & 0xFF) > 0], return_counts=True)
                held.setdefault(lang, []).append((codes, n))
                if len(held[lang]) > 16:
                    settle(lang)
    for lang in held:
        settle(lang)
        codes, n = held[lang][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])


def _at(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted array, and whether they are there."""
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return place, known[place] == wanted


class Trees:
    """Frozen costs in bits: for every language and order sorted (string, cost) and (context, escape)."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """``counts[k]``: (code, count) of language k; code is the three context bytes and the byte."""
        self.langs = langs
        self.levels = [[self._level(code, n, order) for order in range(ORDER + 1)] for code, n in counts]

    @staticmethod
    def _level(code: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
        codes, place = np.unique((code & (1 << 8 * (order + 1)) - 1).astype(np.uint32), return_inverse=True)
        own = np.bincount(place, n)
        contexts, of = np.unique(codes >> 8, return_inverse=True)
        followers, total = np.bincount(of), np.bincount(of, own)
        escape = -np.log2(followers / (total + followers))
        return codes, -np.log2(own / (total + followers)[of]), contexts, escape

    def costs(self, code: np.ndarray, language: int) -> np.ndarray:
        """Bits of the last byte of every code after the three before it."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            codes, direct, contexts, escape = self.levels[language][order]
            own = code[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            if not len(codes) or not len(own):
                continue
            place, there = _at(codes, own)
            out[open_[there]] += direct[place[there]]
            open_, own = open_[~there], own[~there]
            place, there = _at(contexts, own >> 8)
            out[open_[there]] += escape[place[there]]
        out[open_] += 8
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language."""
        sums = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return sums
        text, starts = _padded(data, offsets)
        code = np.ndarray((len(text) - ORDER,), ">u4", np.ascontiguousarray(text), strides=(1,)).astype(np.uint32)
        code, place = np.unique(code, return_inverse=True)
        filled = np.flatnonzero(np.diff(offsets))
        # Padding lies in front of each text only; its bytes and NULs cost nothing.
        for k in range(len(self.langs)):
            cost = np.where((code & np.uint32(0xFF)) == 0, 0, self.costs(code, k))
            sums[filled, k] = np.add.reduceat(cost[place], starts[filled] - ORDER)
        return sums


def train(docs: DataFrame) -> Trees | None:
    """Trees from all (text, lang) rows given."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count_rows, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts, _ = written(counts, "contexts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    found = [counts.filter(F.col("lang") == name).select("code", "n").toPandas() for name in langs]
    return Trees(langs, [(f["code"].to_numpy(np.int64), f["n"].to_numpy(np.float64)) for f in found])


def predict(docs: DataFrame, trees: "Trees | None", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the language's share of the codes' probabilities."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if trees is None:
        return given.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        names = np.array(model.langs, object)
        for batch in batches:
            for part in slices(batch, limit=1_000_000):
                bits = model.bits(*text_bytes(part.column("text")))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                letters = np.array([t is not None and _LETTER.search(t) is not None for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.where(letters, names[best], UNKNOWN).tolist(), pa.string()),
                     pa.array(np.where(letters, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return given.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt outside the held-out fold."""
    model = train(docs.filter(fold(F.col("doc_id"), folds) != held_out).select("text", "lang"))
    return predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
