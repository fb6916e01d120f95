"""Runs of words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sievework.llm import periodic
from sievework.llm.registry import op13_periods

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6, times=4):
    """Every maximal run: for each period the stretches of words equal to those a period later."""
    found, seen = [], set()
    for period in range(1, len(words) // times + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            end = i + period
            if end - start >= max(least, times * period) and (start, end) not in seen:  # smaller periods came first
                seen.add((start, end))
                found.append((start, end - start, period))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract's row for one document."""
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    out = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in out)))


def lyndon(word):
    """Longest Lyndon prefix of every suffix, by definition."""
    n = len(word)
    return [max(k for k in range(1, n - i + 1) if all(word[i:i + k] < word[i + j:i + k] for j in range(1, k))) for i in range(n)]


def test_lyndon_arrays_under_both_orders(monkeypatch):
    rng = random.Random(1)
    for least in (500_000, 4):  # lists, and compact arrays
        monkeypatch.setattr(periodic, "LONG", least)
        for _ in range(150):
            word = [rng.randint(0, 2) for _ in range(rng.randint(1, 13))]
            letters = periodic._Letters(np.array(word))
            assert list(periodic.lyndon_array(letters, False)) == lyndon(word)
            assert list(periodic.lyndon_array(letters, True)) == lyndon([-x for x in word])


def test_runs_of_many_sequences():
    rng = random.Random(2)
    for _ in range(300):
        many = []
        for _ in range(rng.randint(1, 4)):
            n, top = rng.randint(0, 60), rng.choice([1, 2, 3, 8, 30])
            word = [rng.randint(0, top) for _ in range(n)]
            if n > 5 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                word = [word[i] if i < a else word[a + (i - a) % p] for i in range(n)]
            many.append(word)
        first = np.concatenate([[0], np.cumsum([len(w) for w in many])])
        codes = np.array([c for w in many for c in w], np.int64)
        for least, times in ((6, 4), (3, 3)):
            want = [(s + first[k], s + n + first[k], q) for k, w in enumerate(many) for s, n, q in plain_runs(w, least, times)]
            assert list(map(tuple, periodic.runs_of(codes, first, least, times).tolist())) == want
    with pytest.raises(ValueError):
        periodic.runs_of(codes, first, 2, 2)


def test_structured_words():
    """Fibonacci and Thue-Morse words, one letter only, and a period of thousands."""
    fib, other = "b", "a"
    while len(other) < 1500:
        fib, other = other, other + fib
    morse = [bin(k).count("1") % 2 for k in range(2048)]
    long = list(range(3000)) * 5
    for word in (list(other), morse, [7] * 3000, long + [1] * 9 + long):
        codes = np.unique(np.array(word), return_inverse=True)[1].astype(np.int64)
        got = periodic.runs_of(codes, np.array([0, len(codes)]), 6, 4)
        if len(word) < 5000:
            assert [(s, e - s, q) for s, e, q in got.tolist()] == plain_runs(word)
        else:
            assert [0, 15000, 3000] in got.tolist() and [15009, 30009, 3000] in got.tolist() and len(got) == 3


def test_operator(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "a", "x y " * 40 + "z", "é é é é é é\x0bé\x1cé", "ha " * 70_000, "a b c d e f g h " * 9 + "tail"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["   same   same same same\nsame same "] * 3
    rows = [(None if k % 11 == 3 else k, t, "clash", 7, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int, start string")
    found = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(docs).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        words = WORDS.findall(text or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, 70_000, 1)]
        out = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.add((doc_id, len(words), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in out)))
    assert found == want
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["the", "cat", "sat", "on", "mat", str(k)]) for _ in range(rng.randint(0, 120)))) for k in range(150)]
    rows += [(None, "one two three four five six seven"), (3, rows[3][1]), (500, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periods(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) >= 10
