"""The ten operators against plain versions on small, awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import embeddings, files, idfile, language, mixture, multiset, packing, quality, repeats, simhash, tokens, warc

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string, key bigint, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(3000))
    texts = [(1, base), (2, base[:700] + "X" + base[701:]), (3, "q" * 500), (4, None), (5, ""), (6, base[100:299]),
             (7, base[100:300]), (8, base[100:301]), (9, "zz" + base[500:760] + "yy"), (9, "zz" + base[500:760] + "yy"),
             (None, base[2000:2400]), (10, "Hey " * 200), (11, "Hey " * 60 + "é" * 150), (13, "\0" * 240), (14, "  a  b\n\n c ")]
    texts += [(20 + k, "the cat of the house and the dog " * 3 + str(k)) for k in range(4)]
    texts += [(30 + k, "der hund und das haus ist die katze " * 3 + str(k)) for k in range(4)]
    lang = lambda i: "en" if i and 20 <= i < 30 else "de" if i and i >= 30 else None
    return [(i, t, lang(i), None if i == 5 else f"s{(i or 0) % 3}", len(t or ""), "clash", 7, 0.1) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_are_the_librarys():
    odd = ["", " a b", "a  b", "a\nb\n", "\n a", "x\x1cy z", "don't it's", "é İ ΑΣ", " ", "a \n b", "tab\tx", "a b ", "<|endoftext|> a"]
    for path, end in ((BYTES, 2), (WORDS, 1)):
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        want = [[*plain.encode(t, add_special_tokens=False).ids, end] for t in odd]
        encoder = tokens.IdEncoder(path, end)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(odd)] == want


def test_packing(docs, none):
    got = packing.pack(docs, BYTES, capacity=64, with_ids=True).toPandas()
    plain = Tokenizer.from_file(BYTES)
    want = sorted(tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    whole, found = [], []
    for _, own in got[got.doc_id != 9].sort_values("start").groupby("doc_id"):  # id 9 stands twice
        found.append(tuple(np.concatenate([np.frombuffer(b, "<u4") for b in own.ids]).tolist()))
    assert len(found) == len(want) - 3 and set(found) <= set(want)
    for _, own in got.sort_values("start").groupby(got.doc_id.fillna(-1)):
        ids = [np.frombuffer(b, "<u4") for b in own.ids]
        assert [zlib.crc32(b) for b in own.ids] == own.ids_crc32.tolist()
        whole.append(sum(map(len, ids)))
    assert sum(whole) == sum(map(len, want)) == got.length.sum() and got.length.max() <= 64
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack(none, BYTES).count() == 0


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 3000)
    encoder, plain = tokens.IdEncoder(WORDS, 1), Tokenizer.from_file(WORDS)
    for k in range(30):
        texts = [f"word{k} word{k + 1} word{j}" for j in range(20)]
        want = [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
        assert encoder.first.size <= 3000 and len(encoder.first) + len(encoder.first.old) < 60


def test_repeats_beside_clashing_columns(spark):
    text = "".join(chr(97 + k * k % 26) for k in range(400))
    docs = spark.createDataFrame([(1, text, 7, "a"), (2, "own words " + text, 8, "b"), (3, "other", 9, "c")],
                                 "doc_id bigint, text string, key int, kept string")
    kept = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert kept[2].text.startswith("own words") and len(kept[2].text) < 300 and (kept[2].key, kept[2].kept) == (8, "b") and kept[3].text == "other"


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for top in (5, 300, 1024):
        counts = np.bincount(rng.integers(1, top + 1, 3000), minlength=1025)
        runs = packing.plan(counts)
        placed = np.zeros(1025, np.int64)
        for n, lengths in runs:
            assert sum(lengths) <= 1024
            np.add.at(placed, list(lengths), n)
        assert (placed == counts).all()
        assert sum(n for n, _ in runs) <= 1.02 * -(-(counts * np.arange(1025)).sum() // 1024) + 1


def test_grouping_keeps_up_with_plain_best_fit():
    rng = np.random.default_rng(2)
    short, long_ = rng.lognormal(5, 1, 20_000), rng.integers(200, 1025, 20_000)
    for lengths in (short, rng.integers(1, 1025, 20_000), long_, rng.choice([123, 300, 341, 400, 700], 3000)):
        counts = np.bincount(np.clip(lengths, 1, 1024).astype(int), minlength=1025)
        plain = sum(n for n, _ in packing._best_fit([], counts, 1024))
        assert sum(n for n, _ in packing.plan(counts)) <= 1.001 * plain


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = [(1, "u", big), (2, "u\n2", big), (3, None, None), (4, "u", "s"), (5, "u", "s"), (None, "u", "n" * 150), (6, "é", "\x1f\x8b\x08 WARC/1.1" * 30)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    manifest = warc.write_archives(table, f"file://{tmp_path}/w")
    want = None
    for split in (64, 1 << 20):
        got = sorted(map(tuple, warc.read_archives(manifest, split=split).drop("url").collect()), key=str)
        want = want or got
        assert got == want and len(got) == len(pages)
    by_id = {r[0]: r for r in want}
    assert by_id[1][3:5] == ("response", None) and by_id[2][3:5] == ("revisit", 1) and by_id[5][3] == "response"
    for i, _, html in pages:
        raw = (html or "").encode()
        assert by_id[i][1:3] == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.round_trip(table.limit(0)).count() == 0


def test_id_files(docs, none, rows, tmp_path):
    plain = Tokenizer.from_file(WORDS)
    got = idfile.round_trip(docs, WORDS).collect()
    want = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows]
    assert sorted((r.doc_id is not None, r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == sorted(
        (i is not None, i, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert idfile.round_trip(none, WORDS).count() == 0


def test_damage_is_seen(tmp_path):
    path = f"file://{tmp_path}/a.ids"
    ids = (np.random.default_rng(1).zipf(1.3, 9000) % 40_000).astype(np.uint16)
    with files.create(path) as out:
        idfile.write_segment(out, [1, None], [4000, 5000], ids)
    (names, lengths, back), = idfile.read_segments(path)
    assert names == [1, None] and lengths.tolist() == [4000, 5000] and (back == ids).all()
    raw = bytearray((tmp_path / "a.ids").read_bytes())
    raw[-3000] ^= 1
    (tmp_path / "a.ids").write_bytes(raw)
    with pytest.raises(ValueError):
        list(idfile.read_segments(path))


def test_mixture(docs, none, rows):
    got = mixture.mix(docs).collect()
    assert len(got) == len(rows) and mixture.mix(none).count() == 0
    assert sorted(map(tuple, mixture.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    total = sum(r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        size = sum(r.size for r in own)
        assert {r.source_size for r in own} == {size} and own[0].target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in own)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert mixture.mixed(docs).count() == sum(r.copies for r in got)


def test_fitting_counts():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = np.unique(rng.integers(0, 60, 8))
        counts = rng.integers(1, 6, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 2))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {t + k * int(s) for t in sums for k in range(c + 1)}
        chosen = mixture.fit_counts(sizes, counts, budget)
        assert (chosen >= 0).all() and (chosen <= counts).all()
        assert abs(int((chosen * sizes).sum()) - budget) <= min(abs(t - budget) for t in sums) + int(sizes.max())


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = [v.tolist() for v in np.concatenate([base, base[:20] + rng.normal(0, .08, (20, 16)), base[:5], base[:5]])]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [1.0, 2.0], [float("inf")] * 16]
    table = spark.createDataFrame([(k * 3, v, "x") for k, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, same string")
    good = [k for k, v in enumerate(vectors) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([vectors[k] for k in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links, least = dict.fromkeys(range(len(vectors)), 0), {k: k for k in range(len(vectors))}
    for x, k in enumerate(good):
        links[k] = int(near[x].sum())
    for _ in good:
        for x, k in enumerate(good):
            least[k] = min([least[k], *(least[good[y]] for y in np.flatnonzero(near[x]))])
    for block in (8, 8192):
        got = embeddings.near_duplicates(table, block=block).collect()
        assert {r.vec_id // 3: (r.n_links, r.component_id // 3, r.kept) for r in got} == {
            k: (links[k], least[k], least[k] == k) for k in links}
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_deal_few_blocks_to_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2500, 12))
    vectors = np.concatenate([base, base[:1500] + rng.normal(0, .1, (1500, 12))]).astype(np.float32)
    schema, kept = "vec_id bigint, embedding array<float>", {}
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], schema)
    monkeypatch.setattr(embeddings, "written", lambda df, name, write=embeddings.written: kept.setdefault(name, write(df, name)))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))
    tiles = kept["tiles"][0]
    assert tiles.select(F.input_file_name()).distinct().count() > 1


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1.0, 0.0]), (4, [1e300, 0.0]), (5, [0.0, 5e-324]), (6, [0.0, -1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def plain_repeats(rows):
    seen, out = {}, []
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        for p in range(len(b) - 199):
            seen[b[p:p + 200]] = seen.get(b[p:p + 200], 0) + 1
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        gone = gone[:len(b)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, none, rows, monkeypatch):
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == plain_repeats(rows)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 300)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == plain_repeats(rows)
    assert repeats.remove_repeats(none).count() == 0


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash(docs, none, rows):
    for width in (2, 4096):
        got = simhash.near_duplicates(docs, width=width).collect()
        prints = sorted({plain_print(r[1]) for r in rows})
        least = {p: min((r[0] for r in rows if plain_print(r[1]) == p and r[0] is not None), default=None) for p in prints}
        for _ in prints:
            for a in prints:
                near = [least[b] for b in prints if bin(a ^ b).count("1") <= 2 and least[b] is not None]
                least[a] = min(near, default=None)
        want = sorted(((r[0], f"{plain_print(r[1]):016x}", least[plain_print(r[1])]) for r in rows), key=str)
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(docs).count() == len(set(least.values()))


def test_one_row_of_each_class_whatever_its_id(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40)) for _ in range(9)]
    ids = [None, None, None, 5, 5, 6, None, 7, 7]
    table = spark.createDataFrame([*zip(ids, texts), (None, texts[0]), (4, texts[1]), (5, texts[3])], "doc_id bigint, text string")
    want = [(4 if k == 1 else i, t) for k, (i, t) in enumerate(zip(ids, texts))]
    assert sorted(map(tuple, simhash.keep_one(table).collect()), key=str) == sorted(want, key=str)


def test_bit_sliced_pairs():
    rng = np.random.default_rng(5)
    prints = rng.integers(-1 << 63, 1 << 63, 60)
    prints = np.concatenate([prints, prints[:30] ^ 5, prints[:10] ^ (1 << 40)])
    groups = rng.integers(0, 3, len(prints))
    found = {tuple(sorted(p)) for a, b in simhash.PlanePairs(prints, groups, np.full(len(prints), -1), 2).links() for p in zip(a, b)}
    want = {tuple(sorted((prints[i], prints[j]))) for i in range(len(prints)) for j in range(i)
            if groups[i] == groups[j] and bin((int(prints[i]) ^ int(prints[j])) & (1 << 64) - 1).count("1") <= 2}
    assert found == want


def test_bit_sliced_pairs_of_few_rows():
    for n in range(1, 9):
        found = [p for a, b in simhash.PlanePairs(np.arange(n), np.zeros(n, int), np.full(n, -1), 64).links() for p in zip(a, b)]
        assert len(found) == n * (n - 1) // 2


def test_quality(spark, docs, none):
    good = [(k, "the quick brown fox runs over hills, and rests. " * 3 + str(k)) for k in range(300)]
    bad = [(1000 + k, "BUY!! NOW!! " * 12 + str(k)) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id bigint, quality int, toxic int")
    got = quality.classify(table, labels).toPandas()
    assert ((got.doc_id < 1000) == (got.predicted == 1)).mean() > 0.97
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    mixed = quality.classify(docs, labels).toPandas()
    assert len(mixed) == docs.count() and mixed.score.between(0, 1).all()
    assert quality.classify(none, labels).count() == 0 and quality.classify(table, labels.limit(0)).toPandas().score.eq(0.5).all()


def test_language(docs, none):
    model = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert all(got[k][0] == "en" and got[k + 10][0] == "de" for k in range(20, 24))
    assert got[4] == ("und", 0.0) and got[5] == ("und", 0.0) and got[13] == ("und", 0.0)
    assert language.identify(none).count() == 0


def test_language_code_lengths_are_exact(spark):
    texts = {"x": ["abracadabra abba", "zzz"], "y": ["hello hello help"]}
    model = language.train(spark.createDataFrame([(t, k) for k, v in texts.items() for t in v], "text string, lang string"))
    for text in ("abra hello", "zelp Q", "help me abba"):
        data = np.frombuffer(text.encode(), np.uint8)
        for k, bits in zip(model.langs, model.bits(data, np.array([0, len(data)]))[0]):
            counts = {}
            for t in texts[k]:
                b = b"\0\0\0" + t.encode()
                for i in range(3, len(b)):
                    for o in range(4):
                        own = counts.setdefault(b[i - o:i], {})
                        own[b[i]] = own.get(b[i], 0) + 1
            want, b = 0.0, b"\0\0\0" + text.encode()
            for i in range(3, len(b)):
                for o in (3, 2, 1, 0, -1):
                    own = counts.get(b[i - o:i]) if o >= 0 else None
                    if o < 0:
                        want += 8
                    elif own:
                        total = sum(own.values()) + len(own)
                        want -= np.log2(own.get(b[i], len(own)) / total)
                        if b[i] in own:
                            break
            assert bits == pytest.approx(want, rel=1e-5)


def test_language_keeps_every_context(spark):
    """A rare language beside one with more contexts than were kept, and all byte values."""
    rng = random.Random(2)
    draw = lambda n, lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(n))
    hot = [draw(400, 0x20, 0x60) * 2 for _ in range(120)]
    texts = {"hot": hot, "rare": ["".join(chr(c) for c in range(0x80, 0x2000, 7)), "каждый охотник желает знать"]}
    model = language.train(spark.createDataFrame([(t, k) for k, v in texts.items() for t in v], "text string, lang string"))
    tries = ["охотник знает", texts["rare"][0][200:260], hot[5][30:90], "".join(map(chr, range(1, 0x900, 5)))]
    trees = {}
    for k, own in texts.items():
        counts = trees[k] = {}
        for t in own:
            b = b"\0\0\0" + t.encode()
            for i in range(3, len(b)):
                for o in range(4):
                    of = counts.setdefault(b[i - o:i], {})
                    of[b[i]] = of.get(b[i], 0) + 1
    for text in tries:
        data = np.frombuffer(text.encode(), np.uint8)
        for k, bits in zip(model.langs, model.bits(data, np.array([0, len(data)]))[0]):
            want, b = 0.0, b"\0\0\0" + text.encode()
            for i in range(3, len(b)):
                for o in (3, 2, 1, 0, -1):
                    own = trees[k].get(b[i - o:i]) if o >= 0 else None
                    if o < 0:
                        want += 8
                    elif own:
                        want -= np.log2(own.get(b[i], len(own)) / (sum(own.values()) + len(own)))
                        if b[i] in own:
                            break
            assert bits == pytest.approx(want, rel=1e-5)


def test_multiset(docs, none, rows):
    got = multiset.fingerprints(docs).collect()
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    want = {}
    for k, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        want.setdefault(r[0], set()).add((len(text), hashlib.sha256(changed.encode()).hexdigest()))
    assert len(got) == len(rows) and all((r.n_chars, r.edited_sha256) in want[r.doc_id] for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert multiset.fingerprints(none).count() == 0
    a, b = multiset.fingerprint("one two\nthree"), multiset.fingerprint("three\none two")
    assert a.hex() == b.hex() and a.minus(multiset.fingerprint("three")).hex() == multiset.fingerprint("one two").hex()


def test_likeness_of_texts_with_one_line_very_often():
    line = "the same line again\n"
    often, more = multiset.fingerprint(line * 65_536), multiset.fingerprint(line * 65_536 + "and one more line")
    assert 0.999 < often.likeness(more) < 1 and often.minus(multiset.fingerprint(line * 65_535)).hex() != often.hex()
    half = multiset.fingerprint(line * 20_000).likeness(multiset.fingerprint(line * 40_000))
    assert 0.79 < half < 0.81  # 1 - (40 - 20)^2 / (40^2 + 20^2)


def test_small_rows_are_dealt_to_tasks(spark):
    from sievework.llm.shared import dealt

    for start in (spark.range(5), spark.range(0, 5, 1, 1)):
        files = dealt(start)
        assert files.rdd.getNumPartitions() == 5 and sorted(r.id for r in files.collect()) == list(range(5))
    assert len({r.task for r in dealt(spark.range(0, 5, 1, 1)).selectExpr("spark_partition_id() as task").collect()}) == 5
    assert dealt(spark.range(9), most=2).rdd.getNumPartitions() == 2
    assert dealt(spark.range(0)).count() == 0


def test_new_words_are_encoded_together(monkeypatch):
    """Few texts for many new words, also where a word holds what stands between them, and the library's ids."""
    texts = [" ".join(f"{a}{b}{c}" for a in "abc" for b in "xyz" for c in "klm"), "§ € a€b = x\n€ y", "nul\0 byte　wide"]
    for path, end in ((BYTES, 2), (WORDS, 1)):
        plain, encoder, given = Tokenizer.from_file(path), tokens.IdEncoder(path, end), []
        plain.encode_special_tokens = True
        whole = encoder._whole
        monkeypatch.setattr(encoder, "_whole", lambda some: given.extend(some) or whole(some))
        for some in (texts[:1], texts):
            want = [[*plain.encode(t, add_special_tokens=False).ids, end] for t in some]
            assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(some)] == want
            assert some is texts or len(given) <= 2
