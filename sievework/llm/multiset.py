"""Homomorphic multiset hashes of documents.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to
a wide vector, and the text's fingerprint is the sum of the vectors modulo
powers of two, so it does not depend on the order of paragraphs, and adding or
taking out a paragraph is one addition or subtraction (``plus``, ``minus``).

Two kinds of lanes: four lanes modulo 2**64 decide equality; 128 lanes modulo
2**32 hold sums of +-1 over the paragraph's three-word windows, and the
squared length of the difference of two such sketches estimates how many
windows the texts do not share, which gives their likeness.  A text of fewer
than 2**31 windows, more than a row can hold, never wraps a lane.

Defined cases: null text is empty and has fingerprint zero; equal texts have
equal fingerprints; two empty texts have likeness 1, an empty and another 0;
with repeated ids the order is by id and hash of the text; a null id comes
last; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG, LANES, WINDOW = 4, 128, 3
ROWS_PER_BUCKET, MAX_BUCKETS = 4096, 20_000
_CHUNK = 65_536


class Fingerprint:
    """Sum of the vectors of a multiset of paragraphs."""

    __slots__ = ("strong", "lanes")

    def __init__(self, strong: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes

    def plus(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.strong + other.strong, self.lanes + other.lanes)

    def minus(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.strong - other.strong, self.lanes - other.lanes)

    def hex(self) -> str:
        return self.strong.astype("<u8").tobytes().hex() + self.lanes.astype("<u4").tobytes().hex()

    def likeness(self, other: "Fingerprint") -> float:
        """1 for equal multisets, about 0 for texts without a common window."""
        if (self.strong == other.strong).all():
            return 1.0
        own, others, gap = ((x.view(np.int32).astype(np.float64) ** 2).sum() for x in (self.lanes, other.lanes, self.lanes - other.lanes))
        return float(np.clip(1 - gap / (own + others), 0, 1)) if own + others else 0.0


def fingerprint(text: str) -> Fingerprint:
    """Fingerprint of a text: the sum over its paragraphs; blank ends of lines do not matter to the windows."""
    if not text:
        return Fingerprint()
    raw = text.encode("utf-8", "surrogatepass")
    paragraphs = raw.split(b"\n")
    digests = b"".join([hashlib.blake2b(p, digest_size=8 * STRONG).digest() for p in paragraphs])
    strong = np.add.reduce(np.frombuffer(digests, "<u8").reshape(-1, STRONG).astype(np.uint64), axis=0)
    lanes, hashed = np.zeros(LANES, np.int64), []
    digest = xxhash.xxh3_128_digest

    def add() -> None:
        nonlocal lanes
        bits = np.unpackbits(np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, LANES // 8), axis=1)
        lanes += 2 * np.add.reduce(bits, axis=0, dtype=np.int64) - len(bits)
        hashed.clear()

    for paragraph in paragraphs:
        words = paragraph.split()
        if len(words) <= WINDOW:
            hashed.append(digest(b" ".join(words)))
        else:
            hashed.extend(map(digest, map(b" ".join, zip(words, words[1:], words[2:]))))
        if len(hashed) > _CHUNK:
            add()
    if hashed:
        add()
    return Fingerprint(strong, lanes.astype(np.uint32))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, foreign, ...) such that each document stands before the next one of its bucket.

    Buckets are ranges of ids; the first document of each is also given, as a
    foreign row, to the bucket before it (to the last one, round the corner).
    At most ``MAX_BUCKETS`` heads are gathered, ids only.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    given = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(low)).alias("place"), F.xxhash64("text").alias("mark"))
    places = docs.select(F.coalesce("doc_id", F.lit(low)).alias("place"))
    buckets = min(MAX_BUCKETS, max(1, places.count() // ROWS_PER_BUCKET))
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(places.agg(F.percentile_approx("place", cuts, 10 * buckets)).first()[0] or [])) if cuts else []
    edges = F.lit(np.array(bounds, np.int64)) if bounds else F.array().cast("array<bigint>")
    # Number of bounds above: the search of an ordered array, so the largest ids are in bucket 0.
    marked = given.withColumn("bucket", F.lit(len(bounds)) - F.size(F.filter(edges, lambda b: b <= F.col("place"))))
    heads = marked.select("bucket", "place", "mark").groupBy("bucket").agg(
        F.max(F.struct("place", (-F.col("mark")).alias("turned"))).alias("head")).select("bucket", "head.*").orderBy("bucket").collect()
    names = [h["bucket"] for h in heads]
    table = spark.createDataFrame(
        [(h["bucket"], h["place"], -h["turned"], names[k - 1]) for k, h in enumerate(heads)],
        "b bigint, p bigint, m bigint, target bigint")
    first = (F.col("bucket") == F.col("b")) & (F.col("place") == F.col("p")) & (F.col("mark") == F.col("m"))
    joined = marked.join(F.broadcast(table), first, "left")
    own = F.struct(F.col("bucket").cast("bigint").alias("bucket"), F.lit(0).alias("foreign"))
    other = F.struct(F.col("target").alias("bucket"), F.lit(1).alias("foreign"))
    dealt = joined.withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, other))))
    return dealt.select("to.*", "doc_id", "place", "mark", "text").repartition("bucket").sortWithinPartitions(
        "bucket", "foreign", F.desc("place"), "mark")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
             ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    held, rows = None, []
    for batch in batches:
        for bucket, foreign, name, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "foreign", "doc_id", "text"))):
            text = text or ""
            own = fingerprint(text)
            if held and held[0] == bucket and not held[1]:
                before = held[3]
                changed = edited(before, text)
                other = fingerprint(changed)
                rows.append((held[2], len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[4].hex(),
                             other.hex(), held[4].likeness(other), held[4].likeness(own)))
            held = (bucket, foreign, name, text, own)
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row and of its text edited with the next document's, in descending order of ids."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return _with_next(given).mapInArrow(
        _pair_rows, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")
