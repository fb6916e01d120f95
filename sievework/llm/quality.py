"""Quality classifier learnt from trusted positives and unlabelled text.

Non-negative positive-unlabelled learning: with the class prior p the risk of a
scorer g is  p R+(positives) + max(0, R-(unlabelled) - p R-(positives)); when
the second part turns negative the step ascends on it instead, which keeps a
flexible model from explaining the unlabelled texts away.  The prior is
estimated from the two samples alone: a scorer of positives against unlabelled
texts is fitted first, and the smallest ratio of the shares above a threshold,
unlabelled to (held back) positives, bounds the share of positives.

Scores rest on the text alone: frequencies of pairs of character classes,
word repetition and lengths.  The labelled and unlabelled samples are bounded
(``positives`` and ``unlabelled`` rows, those of smallest hash); every text is
scored whole.

Defined cases: null and empty texts have features of an empty text and get a
score as well; a document with both labels is no trusted positive; without any
positive every score is 0.5 (kept).  Other columns are ignored.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import fold, text_bytes

POSITIVES, UNLABELLED = 12_000, 16_000
FOLDS, HELD_OUT = 3, 1
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 30, 512, 0.01, 1e-4, 5

_CLASSES = 12


def _class_table() -> np.ndarray:
    """Class of each byte: space, line end, other control, upper, lower, digit, four kinds of marks, quotes, beyond ASCII."""
    table = np.full(256, 2, np.uint8)
    groups = [b" ", b"\n\r", b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
              b".,;:", b"!?", b"#$%&*@^~+=", b"|<>{}[]\\/_()`", b"'\"-"]
    for k, group in enumerate(groups):
        table[list(group)] = k
    table[128:] = 11
    return table


_TABLE = _class_table()
N_FEATURES = _CLASSES * _CLASSES + _CLASSES + 9


def text_features(raw: bytes) -> np.ndarray:
    """Features of one UTF-8 text."""
    kinds = _TABLE[np.frombuffer(raw, np.uint8)]
    n = len(kinds)
    single = np.bincount(kinds, minlength=_CLASSES) / max(n, 1)
    pairs = np.bincount(kinds[:-1] * np.uint8(_CLASSES) + kinds[1:], minlength=_CLASSES ** 2) / max(n - 1, 1)
    words = raw.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = raw.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    rest = [
        np.log1p(n), np.log1p(len(words)), len(counts) / m, len(counts) / np.sqrt(m), same / m,
        max(counts.values(), default=0) / m, n / m / 10, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / len(lines)),
    ]
    return np.concatenate([np.sqrt(single), np.sqrt(pairs), rest]).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    raw, cut = data.tobytes(), offsets.tolist()
    if len(cut) == 1:
        return np.empty((0, N_FEATURES), np.float32)
    return np.stack([text_features(raw[cut[k]:cut[k + 1]]) for k in range(len(cut) - 1)])


@dataclass
class Scorer:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ w1 + b1, 0) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int, seed: int) -> Scorer:
    """With a prior: non-negative PU risk (sigmoid loss).  Without: positives against unlabelled (logistic loss)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    d = zp.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    step, per = 0, max(1, len(zu) // BATCH)
    for _ in range(epochs):
        po, uo = rng.permutation(len(zp)), rng.permutation(len(zu))
        for k in range(per):
            p, u = zp[po[k * len(zp) // per:(k + 1) * len(zp) // per]], zu[uo[k::per]]
            if not len(p) or not len(u):
                continue
            x = np.concatenate([p, u])
            hidden = np.maximum(x @ w[0] + w[1], 0)
            s = _sigmoid(hidden @ w[2] + w[3][0])
            n = len(p)
            if prior is None:
                grad = np.concatenate([(s[:n] - 1) / n, s[n:] / len(u)])
            else:
                slope = s * (1 - s)  # loss of calling it positive: 1 - s; negative: s
                negative = s[n:].mean() - prior * s[:n].mean()
                if negative >= 0:
                    grad = np.concatenate([-2 * prior * slope[:n] / n, slope[n:] / len(u)])
                else:
                    grad = np.concatenate([prior * slope[:n] / n, -slope[n:] / len(u)])
            back = np.outer(grad, w[2]) * (hidden > 0)
            g = [x.T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ grad + DECAY * w[2], np.array([grad.sum()])]
            step += 1
            for j in range(4):
                first[j] = 0.9 * first[j] + 0.1 * g[j]
                second[j] = 0.999 * second[j] + 0.001 * g[j] ** 2
                w[j] = w[j] - RATE * (first[j] / (1 - 0.9 ** step)) / (np.sqrt(second[j] / (1 - 0.999 ** step)) + 1e-8)
    return Scorer(mean, scale, w, prior or 0.5)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = SEED) -> float:
    """Share of positives among the unlabelled rows: least ratio of the shares above a threshold.

    Only thresholds that at least a quarter of the held-back positives exceed
    are looked at, and a margin for chance is added to the unlabelled share.
    """
    cut = max(1, len(pos) * 7 // 10)
    half = max(1, len(unl) // 2)
    model = _train(pos[:cut], unl[:half], None, EPOCHS // 3, seed)
    kept, rest = np.sort(model.margin(pos[cut:] if cut < len(pos) else pos)), np.sort(model.margin(unl[half:] if half < len(unl) else unl))
    thresholds = np.quantile(kept, np.linspace(0.01, 0.75, 75))
    above_p = 1 - np.searchsorted(kept, thresholds) / len(kept)
    above_u = 1 - np.searchsorted(rest, thresholds) / len(rest)
    chance = np.sqrt(0.5 / len(rest)) + np.sqrt(0.5 / len(kept))
    bound = (above_u + chance) / above_p
    best = int(np.argmin(bound))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _features_of(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample of (part, doc_id, text) rows, in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row.astype("<f4").tobytes() for row in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x binary").toPandas()
    if rows.empty:
        return np.empty((0, N_FEATURES), np.float32)
    x = np.frombuffer(b"".join(rows["x"]), "<f4").reshape(len(rows), N_FEATURES)
    order = np.lexsort((*x.T[:3], rows["doc_id"].fillna(-1).to_numpy(np.float64)))
    return x[order]


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
    folds: int = FOLDS, held_out: int = HELD_OUT,
) -> "Scorer | None":
    """Model from texts outside the held-out fold; at most ``positives`` + ``unlabelled`` rows are gathered."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull())
    ids = base.select("doc_id").filter(fold(F.col("doc_id"), folds) != held_out)
    trusted = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("q")).filter("q = 1").filter(fold(F.col("doc_id"), folds) != held_out).select("doc_id")

    def sample(rows: DataFrame, n: int, salt: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)

    pos = _features_of(base.join(F.broadcast(sample(ids.join(trusted, "doc_id", "left_semi"), positives, 1)).distinct(), "doc_id"))
    unl = _features_of(base.join(F.broadcast(sample(ids, unlabelled, 2)).distinct(), "doc_id"))
    if not len(pos) or not len(unl):
        return None
    rng = np.random.default_rng(SEED)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    prior = estimate_prior(pos, unl)
    return _train(pos, unl, prior, EPOCHS, SEED)


def score(docs: DataFrame, model: Scorer | None, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score between 0 and 1 for every row."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        values = texts.tolist()
        for k in range(0, len(values), 256):
            x = np.stack([text_features((v or "").encode("utf-8", "replace")) for v in values[k:k + 256]])
            out[k:k + 256] = model.score(x)
        return pd.Series(out)

    return docs.withColumn(column, scored(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    folds, held = options.get("folds", FOLDS), options.get("held_out", HELD_OUT)
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text scores below one half."""
    return score(docs, fit(docs, labels, **options), "__score").filter("__score >= 0.5").drop("__score")
