"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards of neighbouring ids.  A shard indexes
(position, turn) to the bitset of its conversations that have this turn there.
Depth first, a node's bitset is met with the postings of the next position;
each meeting that is not empty is a child.  Popcounts give the members, and
conversations whose path is used up are the list of those that end there.

Nodes of different shards are the same where their chained digests agree, so
counts are summed by Spark and no conversation meets all others.  Sums over
subtrees need no walk over the whole trie: a node belongs to its smallest
member, so a conversation owns its path from some depth on; in a second pass
the bitsets of owners and of owned leaves are met with the nodes, and every
sum becomes a sum over members.  Lists of the members that end at a node come
in pieces per shard and are hashed as a stream.

A shard holds ``SHARD`` ids at most, and a conversation is cut into blocks of
``BLOCK`` turns that are walked on their own, each from the digest of all
blocks before it; positions come from a sort by range.  So no task's memory
depends on the length of a conversation or on how many share a turn.

Defined cases: turns go by number, null first, those of one number by a digest
of role and text; null role or text is empty; rows may repeat (each is a
turn); rows without a conv_id belong to no conversation and are left out; an
empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import written

SHARD_BITS, BLOCK = 8, 512
#: The first conversation of each ``FAMILY`` ids gives the others fewer than ``MOST_TAKEN`` turns.
MOST_TAKEN, FAMILY = 9, 5
_START = b"\0" * 16
_NODE = pa.schema(
    [(c, pa.int64()) for c in ("k1", "k2", "p1", "p2", "depth", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "goes_on",
                               "first_end")] + [("ends", pa.string())])
_NODE_DDL = ", ".join(f"{c} bigint" for c in _NODE.names[:-1]) + ", ends string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, tokens): position from 0, turn a digest of role and text, tokens the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("number"),
        F.octet_length(text).cast("bigint").alias("tokens"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn"))
    order = ["conv_id", F.col("number").asc_nulls_first(), "turn"]
    # Sorted by range, so a long conversation lies in several tasks; places inside a task, then the tasks before it.
    placed, _ = written(own.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "tokens", F.monotonically_increasing_id().alias("place")), "turns")
    placed = placed.withColumn("task", F.shiftright("place", 33))
    pieces = placed.groupBy("conv_id", "task").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.select("conv_id", "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("base"))
    return placed.join(base, ["conv_id", "task"]).select("conv_id", (F.col("place") + F.col("base")).alias("position"), "turn", "tokens")


def families(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of all conversations, and turns of conversations rebuilt on the first of their family.

    Each takes up to eight turns of the first of its family of five, then its own later ones.
    """
    own, _ = written(own, "placed")
    names = own.select("conv_id").distinct()
    early = own.filter(F.col("position") < MOST_TAKEN - 1).withColumnRenamed("conv_id", "family")
    family = names.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_TAKEN)
    heads = family.join(early, "family").filter(F.col("position") < F.col("h")).select("conv_id", "position", "turn", "tokens")
    # Where the first of the family has fewer turns than asked for, the later ones move up.
    given = early.groupBy("family").agg(F.count(F.lit(1)).alias("given"))
    gaps = family.join(given, "family", "left").select(
        "conv_id", "h", (F.col("h") - F.least("h", F.coalesce("given", F.lit(0)))).alias("gap"))
    later = own.join(gaps, "conv_id").filter(F.col("position") >= F.col("h")).select(
        "conv_id", (F.col("position") - F.col("gap")).alias("position"), "turn", "tokens")
    return names, heads.unionByName(later)


def _blocks(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, block, path, last, s0..s3): the turns of a block in order, and sums that stand for the blocks before it."""
    paths = rows.groupBy("conv_id", F.floor(F.col("position") / BLOCK).cast("bigint").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("position", "turn", "tokens"))).alias("path"))
    # A conversation without turns has an empty first block.
    firsts = names.select("conv_id", F.lit(0).cast("bigint").alias("block"))
    whole, _ = written(firsts.join(paths, ["conv_id", "block"], "full").select(
        "conv_id", "block", F.coalesce("path", F.expr("cast(array() as array<struct<position:bigint,turn:binary,tokens:bigint>>)")).alias("path")),
        "paths")
    full = whole.filter(F.size("path") == BLOCK)
    chain = F.aggregate("path", F.lit(_START), lambda before, step: F.unhex(F.md5(F.concat(before, step["turn"]))))
    digest = F.md5(F.concat(F.concat(F.col("block").cast("string"), F.lit(":")).cast("binary"), chain))
    ends = full.select("conv_id", "block", digest.alias("digest"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.select("conv_id", (F.col("block") + 1).alias("block"), *[
        F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint")).over(upto).alias(f"s{k}") for k in range(4)])
    reach = whole.groupBy("conv_id").agg(F.max("block").alias("top"))
    joined = whole.join(sums, ["conv_id", "block"], "left").join(reach, "conv_id")
    return joined.select("conv_id", "block", "path", (F.col("block") == F.col("top")).alias("last"),
                         *[F.coalesce(f"s{k}", F.lit(0)).alias(f"s{k}") for k in range(4)])


def _lanes(block: int, inner: bytes) -> tuple[int, ...]:
    """Four numbers of 32 bits that stand for a whole block at its place."""
    return struct.unpack(">4I", hashlib.md5(str(block).encode() + b":" + inner).digest())


def _key(start: tuple, inner: bytes) -> tuple[int, int]:
    """Key of a node from the sums for the blocks before its own, and the chain inside its own."""
    return struct.unpack(">qq", hashlib.md5(",".join(map(str, start)).encode() + b"/" + inner).digest())


class _Shard:
    """The conversations of one shard inside one block of positions, in ascending order of ids."""

    def __init__(self, block: int):
        self.block = block
        self.names: list[int] = []
        self.groups: dict[tuple, int] = {}  # sums for the blocks before -> bitset
        self.postings: list[dict[bytes, int]] = []
        self.paths: list[list[bytes]] = []
        self.tokens: dict[bytes, int] = {}
        self.started: dict[int, int] = {}  # depth -> bitset of those that own their path from there on
        self.leaves = self.last = 0
        self.tails: list[int] = []

    def add(self, name: int, path: list[dict], last: bool, start: tuple, owned: int | None, leaf: int | None, tail: int | None) -> None:
        bit = 1 << len(self.names)
        self.names.append(name)
        self.groups[start] = self.groups.get(start, 0) | bit
        self.paths.append([step["turn"] for step in path])
        self.tails.append(tail or 0)
        while len(self.postings) < len(path):
            self.postings.append({})
        for own, step in zip(self.postings, path):
            own[step["turn"]] = own.get(step["turn"], 0) | bit
            self.tokens[step["turn"]] = step["tokens"]
        if owned is not None:
            self.started[owned] = self.started.get(owned, 0) | bit
        if leaf:
            self.leaves |= bit
        if last:
            self.last |= bit

    def _places(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def nodes(self) -> Iterator[tuple]:
        """Rows of ``_NODE``.

        The node a later block starts from is a row of the block before it; here only its children are added.
        """
        low = self.block * BLOCK
        owners = []  # at [k] those that own their node at depth low + k
        for k in range(len(self.postings) + 1):
            owners.append((owners[-1] if k else 0) | sum(
                bits for depth, bits in self.started.items() if (depth <= low if k == 0 else depth == low + k)))
        for start, bits in self.groups.items():
            yield from self._walk(start, bits, owners)

    def _walk(self, start: tuple, bits: int, owners: list[int]) -> Iterator[tuple]:
        ends = [0] * (BLOCK + 1)
        for k in self._places(bits & self.last):
            ends[len(self.paths[k])] |= 1 << k
        # A frame: depth in the block, chain, key, parent's key, tokens of the last turn, members, those that have no
        # child yet, children, children owned here, saved by deeper nodes.
        stack = [[0, _START, _key(start, _START), (None, None), 0, bits, bits & ~ends[0], 0, 0, 0]]
        while stack:
            frame = stack[-1]
            depth, chain, key, parent, tokens, members, rest, children, owned, saved = frame
            if rest and depth < BLOCK:
                turn = self.paths[(rest & -rest).bit_length() - 1][depth]
                child = members & self.postings[depth][turn]
                frame[6] &= ~child
                frame[7] += 1
                frame[8] += (child & owners[depth + 1]).bit_count()
                inner = hashlib.md5(chain + turn).digest()
                if depth + 1 == BLOCK:
                    name = _key(tuple(a + b for a, b in zip(start, _lanes(self.block, inner))), _START)
                else:
                    name = _key(start, inner)
                stack.append([depth + 1, inner, name, key, self.tokens[turn], child, child & ~ends[depth + 1], 0, 0, 0])
                continue
            stack.pop()
            if depth == 0 and self.block:
                yield *key, None, None, self.block * BLOCK, 0, None, owned, 0, 0, 1, None, None
                continue
            n = members.bit_count()
            saved += tokens * (n - (members & owners[depth]).bit_count())
            if depth == BLOCK:
                saved += sum(self.tails[k] for k in self._places(members))
            if stack:
                stack[-1][9] += saved
            ended = [self.names[k] for k in self._places(members & ends[depth])]
            yield (*key, *parent, self.block * BLOCK + depth, n, self.names[(members & -members).bit_length() - 1], owned,
                   (members & self.leaves).bit_count(), saved, int(len(ended) < n), ended[0] if ended else None,
                   ",".join(map(str, ended)) if ended else None)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, at, rows = None, None, []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _NODE)], schema=_NODE)
        rows.clear()
        return out

    def settle() -> Iterator[pa.RecordBatch]:
        for row in shard.nodes() if shard else ():
            rows.append(row)
            if len(rows) >= 5000:
                yield batch()

    for given in batches:
        for row in given.to_pylist():
            here = (row["conv_id"] >> SHARD_BITS, row["block"])
            if here != at:
                yield from settle()
                shard, at = _Shard(row["block"]), here
            shard.add(row["conv_id"], row["path"], row["last"], tuple(row[f"s{k}"] for k in range(4)), row["owned"], row["leaf"], row["tail"])
    yield from settle()
    if rows:
        yield batch()


def _walked(blocks: DataFrame, name: str) -> DataFrame:
    given = blocks.withColumn("shard", F.shiftright("conv_id", SHARD_BITS)).repartition("shard", "block").sortWithinPartitions(
        "shard", "block", "conv_id").drop("shard")
    return written(given.mapInArrow(_shard_rows, _NODE_DDL), name)[0]


def _with_owners(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The blocks with the depth each conversation owns its path from, whether its end is a leaf it owns, and its tail.

    The tail is the text of the blocks to come that other conversations own.
    """
    merged = nodes.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("goes_on").alias("goes_on"))
    owners = merged.groupBy("conv_id").agg(F.min("depth").alias("owned"), F.max(1 - F.col("goes_on")).alias("leaf"))
    joined = blocks.join(owners, "conv_id", "left")
    foreign = F.aggregate(F.filter("path", lambda s: F.col("owned").isNull() | (s["position"] + 1 < F.col("owned"))), F.lit(0).cast("bigint"),
                          lambda total, s: total + s["tokens"])
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    long = joined.filter((F.col("block") > 0) | ~F.col("last")).select("conv_id", "block", foreign.alias("foreign"))
    tails = long.select("conv_id", "block", F.coalesce(F.sum("foreign").over(later), F.lit(0)).alias("tail"))
    return joined.join(tails, ["conv_id", "block"], "left")


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined lists of each key; lists of a key follow each other in order."""
    at, digest = None, None
    names = ["k1", "k2", "ends_sha256"]
    for batch in batches:
        out = []
        for k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
            if (k1, k2) == at:
                digest.update(b"," + ends.encode())
                continue
            if at:
                out.append((*at, digest.hexdigest()))
            at, digest = (k1, k2), hashlib.sha256(ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names)


def trie(names: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, the empty one included.

    ``names`` holds the conversations (conv_id), ``rows`` their turns
    (conv_id, position from 0, turn, tokens).
    """
    blocks, _ = written(_blocks(names, rows), "blocks")
    none = blocks.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("owned", "leaf", "tail")])
    parts = _walked(_with_owners(blocks, _walked(none, "first-walk")), "second-walk")
    sums = parts.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    nodes, _ = written(sums, "nodes")
    ends = parts.filter(F.col("ends").isNotNull()).select("k1", "k2", "first_end", "ends").repartition("k1", "k2").sortWithinPartitions(
        "k1", "k2", "first_end").mapInArrow(_end_rows, "k1 bigint, k2 bigint, ends_sha256 string")
    # Each parent is one row; a parent of very many children is a skewed join, which AQE splits.
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["p1", "p2"], "left").join(ends, ["k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations as they are."""
    own, _ = written(turns(conversations), "placed")
    return trie(own.select("conv_id").distinct(), own)


def family_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations rebuilt on the first of their family."""
    return trie(*families(turns(conversations)))
