"""Prefix trie against a plain one built of dictionaries."""

import hashlib
import random
import zlib

import pytest

from sievework.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key bigint, depth string"


def digest_of(role, text):
    return hashlib.md5(str(len(role.encode())).encode() + b":" + role.encode() + text.encode()).digest()


def plain(rows, families):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest_of(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = own
    if families:
        paths = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            paths[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        ends = [c for c in members if len(paths[c]) == len(prefix)]
        childless = lambda p: not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)
        out.append((members[0], len(prefix), nodes[prefix[:-1]][0] if prefix else None, len(members),
                    sum(len(q) == len(prefix) + 1 for q in below), sum(childless(p) for p in below),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            turn = None if t == 0 and rng.random() < 0.1 else rng.choice([t, t, t, 1])
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), rng.choice(["hi", "hi", "hé", "", None]), 1, "x"))
    return rows


@pytest.mark.parametrize("families", [False, True])
def test_against_plain(spark, monkeypatch, families):
    rows = made(1, [*range(40), 900, 901, 5_000_000_003, 777_777, -7], 9) + [(None, 0, "user", "lost", 1, "x")]
    rows += [(c, t, "user", "the same", 1, "x") for c in range(60, 75) for t in range(4)]  # copies
    run = trie.family_trie if families else trie.prefix_trie
    for shard, block in ((8, 512), (2, 512), (3, 3), (1, 1)):  # short blocks cut every conversation
        monkeypatch.setattr(trie, "SHARD_BITS", shard)
        monkeypatch.setattr(trie, "BLOCK", block)
        got = sorted(map(tuple, run(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        assert got == plain(rows, families), (shard, block)


def test_one_conversation_holds_most_turns(spark):
    rows = [(4, t, "user", f"turn {t % 7}", 1, "x") for t in range(1300)] + [(5, t, "user", f"turn {t % 7}", 1, "x") for t in range(1030)]
    rows += [(3, 0, "user", "turn 0", 1, "x")]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 1301
    assert got[3, 0].n_convs == 3 and got[3, 0].n_leaves == 1 and got[3, 0].saved_tokens == 6 * 1030 + 6
    assert got[4, 1024].n_convs == 2 and got[4, 1024].saved_tokens == 6 * 7 and got[4, 1024].n_children == 1
    assert got[4, 1031].parent_conv_id == 4 and got[4, 1300].n_children == 0


def test_empty_table(spark):
    assert trie.family_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x")], SCHEMA)).count() == 0
