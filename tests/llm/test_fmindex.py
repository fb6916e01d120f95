"""Decontamination against plain comparison of windows."""

import hashlib
import random
import re

import numpy as np

from sievework.llm import fmindex
from sievework.llm.registry import op11_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, width=10):
    known = {}
    for item, text, *_ in items:
        w = words_of(text)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            known.setdefault(tuple(w[k:k + width]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w = words_of(text)
        hit, named = set(), set()
        for size in {len(p) for p in known}:
            for k in range(len(w) - size + 1):
                own = known.get(tuple(w[k:k + size]))
                if own:
                    hit.update(range(k, k + size))
                    named |= own
        names = sorted((str(i) for i in named if i is not None), key=str.encode)
        out.append((doc, len(w), sorted(hit), names))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.n_words, sorted(k for s in r.spans for k in range(s.start, s.end)), r["items"]) for r in found.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(9, 25)))) for k in range(12)]
    items += [(100, "One, two-three!"), (101, ""), (102, None), (103, "É"), (None, "nameless words here"), (3, "same id again one"),
              (104, items[0][1]), (105, items[0][1].upper() + " more")]
    docs = []
    for k in range(120):
        text = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text += rng.choice([" ", "\n", "; "]) + rng.choice(items)[1:][0].__str__().replace(" ", rng.choice([" ", ", "])) + " end"
        docs.append((k, text))
    docs += [(500, None), (501, ""), (None, "One two three É É"), (7, docs[7][1]), (502, "é É x\x00ONE\x7ftwo{three"), (503, "nameless words here")]
    return docs, items


def test_suffixes_and_index(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        text = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 70))] + [0])
        want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
        assert fmindex.sorted_suffixes(text).tolist() == want
    many = np.array([*[1] * 5000, 0])
    assert fmindex.sorted_suffixes(many).tolist() == list(range(5000, -1, -1))
    numbers = np.array([rng.randint(1, 5) for _ in range(400)])
    first = np.array([0, 0, 90, 90, 300, 400])
    index = fmindex.Index.built(numbers, first)
    for size in (1, 2, 4):
        asked = np.array([[rng.randint(1, 5) for _ in range(size)] for _ in range(50)])
        low, high = index.search(asked, np.full(50, size))
        for window, a, b in zip(asked, low, high):
            places = index.locate(np.arange(a, b))
            want = [k + d for d, (s, e) in enumerate(zip(first, first[1:])) for k in range(s, e - size + 1) if (numbers[k:k + size] == window).all()]
            assert sorted(places.tolist()) == want


def test_operator(spark, monkeypatch):
    docs, items = made(1)
    d = spark.createDataFrame([(*r, "clash", 5) for r in docs], "doc_id bigint, text string, spans string, n_words int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, words int")
    for size, batch in ((8_000_000, 50_000), (200, 7), (1, 1)):
        monkeypatch.setattr(fmindex, "SHARD_BYTES", size)
        monkeypatch.setattr(fmindex, "BATCH", batch)
        monkeypatch.setattr(fmindex, "AT_ONCE", max(batch // 3, 1))
        assert rows_of(fmindex.contamination(d.repartition(3), b)) == plain(docs, items)
    assert rows_of(fmindex.contamination(d, b, 4)) == plain(docs, items, 4)
    assert rows_of(fmindex.contamination(d, b.limit(0))) == [(*r[:2], [], []) for r in plain(docs, items)]
    assert fmindex.contamination(d.limit(0), b).count() == 0


def test_long_text(spark):
    """A text beyond several slices, with windows across every slice bound."""
    rng = random.Random(9)
    text = " ".join(str(rng.randint(0, 3000)) for _ in range(700_000))
    w = text.split()
    items = [(k, " ".join(w[k * 50_000:k * 50_000 + 12])) for k in range(14)]
    found = fmindex.contamination(spark.createDataFrame([(1, text)], "doc_id bigint, text string"),
                                  spark.createDataFrame(items, "item_id bigint, text string")).first()
    assert [(s.start, s.end) for s in found.spans] == [(k * 50_000, k * 50_000 + 12) for k in range(14)] and len(found["items"]) == 14


def test_cut_texts(spark):
    rows = spark.createDataFrame([("Keep, ONE two; three? Tail é", [(1, 4)], 1), ("a b", [], 2), (None, None, 3), ("x y", [(0, 2)], 4)],
                                 "text string, spans array<struct<start:bigint,end:bigint>>, other int")
    assert [r.text for r in fmindex.without_spans(rows).orderBy("other").collect()] == ["Keep, ? Tail é", "a b", None, ""]


def test_query(spark, tmp_path):
    docs, items = made(2)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, op11_decontaminate(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, len(hit), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(hit))
                          for d, n, hit, i in plain(docs, items)), key=str)
