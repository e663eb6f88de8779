"""The training-data operators against brute force, held-out rows and exact round trips, and on awkward tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexgraph.llm import common, decontaminate, ivfpq, langid, mixture, registry, separators, simhash, suffixarray, suffixtree, tokenfile, tokens, toxicity, words
from tests.llm import brute
from tests.oracle import connect, rows_of, rows_of_sql

LONG = "lorem " * 30_000
PASSAGE = " ".join(f"w{k}" for k in range(60))
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, "12 34 !!", "en", "s"),
    (4, "the cat sat on the mat and the dog ran off to the old barn", "en", "s"),
    (5, "the cat sat on the mat and the dog ran off to the old barn", "en", None),
    (5, "the cat sat on the mat and the dog ran off to the old barn", "en", None),
    (6, LONG, "de", "t"),
    (None, f"before {PASSAGE} after", "de", "t"),
    (7, f"other {PASSAGE} words é ü 漢字", None, "t"),
    (8, "a\u0000b \u0085 c\x1cd <|endoftext|> 'S don't % %%", "fr", "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHES = "row fp n h _h root u slot score lang_pred spans items n_words word tf known base weight tokens topic _topic part block start".split()


@pytest.fixture(scope="module")
def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def small(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 8


def expect_simhash(rows):
    fp = [brute.simhash(t) for _, t in rows]
    group = brute.components(fp)
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, f, least[g]) for (d, _), f, g in zip(rows, fp, group)), key=repr)


def unsigned(rows):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows), key=repr)


def test_simhash_is_brute_force(docs, small):
    assert unsigned(simhash.near_duplicates(docs).collect()) == expect_simhash(small)


def test_simhash_awkward(awkward, empty):
    assert unsigned(simhash.near_duplicates(awkward).collect()) == expect_simhash(texts(AWKWARD))
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(kept.select("doc_id").collect(), key=repr) == sorted([(1,), (3,), (4,), (6,), (7,), (8,)], key=repr)  # the row without id shares 56 of 63 shingles with 7


def test_links_lose_nothing_in_hot_buckets(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    keys = {base}
    while len(keys) < 300:  # many keys close together, split by small buckets
        keys.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    keys = sorted(keys)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    root = {r.v: r.root for r in simhash.components(simhash.links(df, bucket=8)).collect()}
    got = [root.get(k, k) for k in signed]
    want = brute.components(keys)
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


# 6


def test_similar_documents(spark, monkeypatch):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 200, 900]))]
        for k in range(3):
            w = list(base)
            for at in range(0, len(w) if k else 0, 60):  # about 1 of 60 words, so some 8 % of the shingles of each
                w[min(at + rng.randrange(60), len(w) - 1)] = f"x{rng.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    more = [(1000, None), (1001, ""), (1002, "one two"), (1003, "one two"), (1004, "two one"), (1005, LONG), (None, "one  TWO")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    for bucket in (simhash.BUCKET, 2):
        root = {r.doc_id: r.root for r in simhash.similar_documents(df, bucket=bucket).collect()}
        pairs = [(3 * g + i, 3 * g + j) for g in range(60) for i in range(3) for j in range(i)]
        assert sum(root[a] == root[b] for a, b in pairs) > 0.9 * len(pairs)
        assert len({(root[d], group[d]) for d in group}) == len({root[d] for d in group})  # no two groups meet
        assert root[1000] == root[1001] and root[1002] == root[1003] == root[None] != root[1004]
    left = simhash.one_of_each(df).collect()
    assert {r.doc_id for r in left} >= {1000, 1002, 1004, 1005} and not {r.doc_id for r in left} & {1001, 1003, None}


def _long(bits):
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def test_close_links_what_a_far_hub_would_hide(spark):
    """Each bucket's forest is of links that hold by all bits, not of sketches alone."""
    rng = np.random.default_rng(3)
    rows, base = [], rng.integers(0, 2, (3, 512))
    for k in range(30):
        rows.append((k + 1, _long(np.where(rng.random(512) < 0.05, 1 - base[k % 3], base[k % 3]))))
    fps = spark.createDataFrame(rows, "id long, fp binary")
    met = fps.selectExpr("1L AS key", "id")
    edges = simhash._bucketed(met, fps, 90, 512)
    root = {r.v: r.root for r in simhash.components(edges).collect()}
    assert len(edges.collect()) == 27 and all(root.get(k + 1, k + 1) == k % 3 + 1 for k in range(30))


def test_hot_keys_lose_no_close_pair(spark):
    """Ids of one key whose sketches share no quarter are compared too."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 512)
    rows = [(k + 1, _long(np.where(rng.random(512) < 0.05, 1 - base, base)), int(rng.integers(-(2**62), 2**62))) for k in range(40)]
    rows += [(100 + k, _long(rng.integers(0, 2, 512)), int(rng.integers(-(2**62), 2**62))) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, fp binary, sketch long")
    edges = simhash._hot(df.selectExpr("1L AS key", "id", "sketch"), spark.createDataFrame([], "a long, b long"), df.select("id", "fp"), 90, 512, 4)
    root = {r.v: r.root for r in simhash.components(simhash.stored(edges)).collect()}
    assert {root.get(k, k) for k in range(1, 41)} == {1} and all(root.get(100 + k, 100 + k) == 100 + k for k in range(10))


def test_block_plan():
    for n in (10, 10**5, 10**8):
        bits, blocks, most = simhash.block_plan(n)
        p = math.acos(1.6 / 1.8) / math.pi
        assert 1 - (1 - (1 - p) ** bits) ** blocks >= 0.95 and most < 0.25 * bits * blocks


def test_decontamination_is_brute_force(spark, docs, small, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = sorted(brute.decontaminate(small, texts(items.collect())), key=repr)
    assert bag(decontaminate.digest(decontaminate.overlaps(docs, items))) == want
    assert bag(decontaminate.digest(decontaminate.overlaps(docs, items, group_mb=0.002))) == want  # several groups


def test_decontamination_awkward(spark, awkward, empty):
    items = [(1, PASSAGE), (None, "the CAT sat"), (3, None), (4, ""), (5, "12"), (5, "cat"), (9, "漢字"), (10, "the cat sat on the mat and the dog ran off")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert bag(decontaminate.digest(decontaminate.overlaps(awkward.select("doc_id", "text"), df))) == sorted(brute.decontaminate(texts(AWKWARD), items), key=repr)
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.overlaps(awkward, df.limit(0))).collect())
    assert decontaminate.overlaps(empty, df).collect() == []


# 7


@pytest.mark.parametrize("group", [4096, 2, 1])
def test_suffix_array_is_brute_force(docs, small, group):
    got = bag(suffixarray.remove_repeats(docs, group=group, digest=True))
    assert got == sorted(((d, *b) for (d, _), b in zip(small, brute.repeats([(t or "").encode() for _, t in small]))), key=repr)


def test_suffix_array_awkward(awkward, empty):
    rows = texts(AWKWARD)
    assert bag(suffixarray.remove_repeats(awkward, digest=True)) == sorted(((d, *b) for (d, _), b in zip(rows, brute.repeats([(t or "").encode() for _, t in rows]))), key=repr)
    assert suffixarray.remove_repeats(empty).collect() == []
    kept = {r.doc_id: bytes(r.kept) for r in suffixarray.remove_repeats(awkward).collect()}
    assert kept[4] == AWKWARD[3][1].encode() and kept[6] == b""


@pytest.mark.parametrize("seed", range(8))
def test_two_stage_sorting(seed):
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(97, 99 + seed % 4, rng.integers(0, 50)).astype(np.uint8)) for _ in range(9)]
    n = Counter(s[i : i + 8] for s in strings for i in range(len(s) - 7))
    assert [x.tolist() for x in suffixarray.repeated(strings, 8)] == [[i for i in range(len(s) - 7) if n[s[i : i + 8]] > 1] for s in strings]


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_asked_for(seed):
    """They are in the order that they have among all, and few others are sorted with them."""
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(97, 98 + seed, 300).astype(np.uint8)) for _ in range(20)]
    raw = b"\0".join(strings) + bytes(208)
    t = np.frombuffer(raw, np.uint8)[: 301 * 20].astype(np.int64) + 1
    t[300::301] = 0
    asked = np.arange(len(t)) % 301 <= 100
    some = suffixarray.sort_suffixes(t, raw, 200, asked)
    assert len(some) == len(set(some.tolist())) and set(some.tolist()) >= set(np.flatnonzero(asked).tolist())
    of = [bytes(raw[p : p + 200]) for p in some[asked[some]]]
    assert of == sorted(of) and (seed == 0 or len(some) < 0.5 * len(t))


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixarray, "CHUNK", 700)
    monkeypatch.setattr(suffixarray, "_TABLES", {})
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    r = suffixarray.Regions([text, text[:150], b""])
    starts = sorted(s for a, e in zip(r.start, r.end) for s in range(a, e - suffixarray.LENGTH + 1))
    assert starts == list(range(3000 - suffixarray.LENGTH + 1)) and set(r.text) == {0}


# 4


def test_languages_of_held_out_rows(spark, data):
    got = langid.op4_langid(spark, data).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_network_is_plain_loops():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    p = langid.train(rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40), 3, epochs=1)
    reach = max(langid.WIDTHS)
    w = p["w"].reshape(reach, langid.EMBED, -1)
    for window, got in zip(x, langid.probabilities(p, x)):
        act = []
        for k, width in enumerate(langid.WIDTHS):
            for f in range(k * langid.FILTERS, (k + 1) * langid.FILTERS):
                places = [sum(float(p["e"][window[at + j]] @ w[j, :, f]) for j in range(width)) for at in range(langid.WINDOW - reach + 1)]
                act.append(max(0.0, max(places) + float(p["b"][f])))
        z = np.array(act) @ p["u"] + p["c"]
        assert np.allclose(got, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_languages_awkward(awkward, empty, docs):
    model = langid.fit(docs)
    got = langid.predict(awkward.select("doc_id", "text", "lang_pred"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(AWKWARD) and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[6].lang_pred in model[1]
    assert langid.predict(empty, model).collect() == [] and langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(awkward, None).collect()} == {"und"}


# 1


def test_toxicity_on_made_labels(spark):
    rng = np.random.default_rng(0)
    words = [f"v{k}" for k in range(80)]

    def text(bad):
        w = list(rng.choice(words, 60))
        return " ".join(w[:30] + ["vile"] * bad + w[30:])

    rows = [(k, text((k % 3) * 3)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.severity_model(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].toxic == (k % 3 > 0) for k in range(600))
    mean = [np.mean([got[k].expected_severity for k in range(600) if k % 3 == m]) for m in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.severity_model(awkward, none) is None
    got = toxicity.score(awkward, None).collect()
    assert len(got) == len(AWKWARD) and not any(r.toxic for r in got)
    assert toxicity.score(empty, None).collect() == []


def test_ordinal_gradient():
    rng = np.random.default_rng(2)
    at, value, row = rng.integers(0, 5, 60), rng.random(60), rng.integers(0, 20, 60)
    grade, weight = rng.integers(0, 3, 20), np.full(20, 0.05)
    grade[:3] = [0, 1, 2]
    v = rng.normal(0, 0.3, 7)
    args = (at, value, row, grade, weight, 5, 0.01)
    g = toxicity._loss(v, *args)[1]
    e = 1e-6 * np.eye(7)
    assert np.allclose(g, [(toxicity._loss(v + d, *args)[0] - toxicity._loss(v - d, *args)[0]) / 2e-6 for d in e], atol=1e-6)


def test_ordinal_fit_is_the_minimum():
    """The fitted weights against the objective written plainly: it is convex in weights and thresholds, so no step near or far may lower it."""
    rng = np.random.default_rng(6)
    rows = [{int(j): float(rng.random()) for j in rng.choice(6, 3, replace=False)} for _ in range(80)]
    grade = np.array([0, 1, 2] + [int(sum(r.get(j, 0) for j in (0, 1)) + rng.random() > 0.9) + int(r.get(0, 0) > 0.6) for r in rows[3:]])
    weight = rng.random(80) + 0.5
    at, value, row = (np.array(x) for x in zip(*((j, x, i) for i, r in enumerate(rows) for j, x in r.items())))
    w, theta = toxicity.fit(at, value, row, grade, weight, 6, l2=0.05, rounds=500)

    def loss(w, theta):
        total = 0.05 / 2 * sum(x * x for x in w)
        for r, g, k in zip(rows, grade, weight / weight.sum()):
            z = sum(w[j] * x for j, x in r.items())
            below = [1 / (1 + math.exp(z - t)) for t in theta] + [1.0]
            total -= k * math.log(below[g] - (below[g - 1] if g else 0.0))
        return total

    best = loss(w, theta)
    assert len(theta) == 2 and theta[0] < theta[1]
    for k in range(300):
        d, e = rng.normal(size=6), rng.normal(size=2)
        size = 10.0 ** -(k % 5) / 2
        t = theta + size * e
        if t[0] < t[1]:
            assert loss(w + size * d, t) >= best - 1e-6


# 2


def test_token_counts(docs, small, awkward, empty):
    enc = separators._encoding(tokens.tokenizer_path(separators.TOKENIZER))
    count = lambda rows: sorted(((d, len(enc.encode_ordinary(t or "")) + 1) for d, t in rows), key=repr)
    assert bag(separators.token_counts(docs)) == count(small)
    assert bag(separators.token_counts(awkward, block=64)) == count(texts(AWKWARD))  # documents over several blocks
    assert separators.token_counts(empty).collect() == []


def test_long_white_space(spark):
    enc = separators._encoding(tokens.tokenizer_path(separators.TOKENIZER))
    space = ["", " ", "\n", "\t \n", "\u3000 ", "\x1c\x1d"]
    for k in (separators.LONG_RUN - 1, separators.LONG_RUN, 1500):
        for s in space:
            run = (s * k)[: max(k, 1)]
            for t in (run, f"a{run}b", f"{run}.", f"x{run}", f"{run}'s{run}\n9{run}"):
                assert separators.encode(enc, t) == enc.encode_ordinary(t)
    long = [(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, None)]
    got = dict(tuple(r) for r in separators.token_counts(spark.createDataFrame(long, "doc_id long, text string")).collect())
    piece = lambda t: len(enc._core_bpe.encode_single_piece(t))
    assert got == {1: piece(b" " * 1_000_000) + 1, 2: piece(b"\n" * 999_999) + 4, 3: 1}


@pytest.mark.parametrize("span", [4096, 2, 1])
def test_scan_of_flat_files(spark, monkeypatch, span):
    monkeypatch.setattr(separators, "RANGE", span)
    flat = np.array([5, 9, 5, 5, 9, 9, 5, 5, 5, 5, 5, 9, 5], "<u2")
    for block in (1, 2, 3, 13):
        rows = [(0, k // block, flat[k : k + block].tobytes()) for k in range(0, 13, block)]
        got = bag(separators.count_documents(spark.createDataFrame(rows, "part int, block long, data binary"), end=9))
        assert got == [(0, 0, 0, 2), (0, 1, 2, 3), (0, 2, 5, 1), (0, 3, 6, 6), (0, 4, 12, 1)]


# 5


@pytest.mark.parametrize("n", [0, 1, 3, 511, 512, 513, 5000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 50000, np.zeros(n, int)):
        lanes, sizes, words = tokenfile.encode_ids(ids)
        assert (tokenfile.decode_ids(n, lanes, sizes, words) == ids).all()


def test_coder_round_trip_of_rare_ids(monkeypatch):
    rng = np.random.default_rng(8)
    ids = np.where(rng.random(200_000) < 0.0005, rng.integers(0, 65536, 200_000), np.arange(200_000) % 50)
    for most in (tokenfile._MOST, 1 << 20):
        monkeypatch.setattr(tokenfile, "_MOST", most)
        lanes, sizes, words = tokenfile.encode_ids(ids)
        assert (tokenfile.decode_ids(len(ids), lanes, sizes, words) == ids).all()


def test_coder_compresses_repeats():
    ids = np.tile(np.arange(300), 200)
    assert len(tokenfile.encode_ids(ids)[2]) * 4 < 0.4 * 2 * len(ids)


def test_blocks_notice_damage():
    block = tokenfile.write_block([1, None], [b"\1\0\2\0", b"\2\0"])
    assert tokenfile.read_block(block) == ([1, None], [2, 1], b"\1\0\2\0\2\0")
    with pytest.raises(ValueError):
        tokenfile.read_block(block[:-1] + bytes([block[-1] ^ 255]))
    with pytest.raises(ValueError):
        tokenfile.read_block(b"none" + block[4:])


def expect_file(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path(tokenfile.TOKENIZER))
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_token_file(docs, small, awkward, empty):
    assert bag(tokenfile.round_trip(docs)) == expect_file(small)
    assert bag(tokenfile.round_trip(awkward)) == expect_file(texts(AWKWARD))
    assert tokenfile.round_trip(empty).collect() == []


def test_pieces_are_encoded_like_whole_texts():
    enc = tokens.Encoder(tokens.tokenizer_path(tokenfile.TOKENIZER))
    hard = ["It's I'LL we'd 'tis don't", "a,b c... d!? e;", "É́a Ａ½ ǅ İ ß Σσς", "x y z\u0085w\x1cv", "<|startoftext|>a <|endoftext|>", "12ab3 漢字かな̀ é́", "\t\r\n\x0b\x0c", "K Å ﬁ"]
    hard += ["a=\u0338b .e\u0301 x.y'z \"'s a'b'c. (it's) '(s", "q" * 500 + "." * 300 + "r,s" * 200, "", "A.B!C?9x-9,x é.a a.é", "x\x00y \x7f.a", "a<|endoftext|>.b,<|startoftext|>c |x|> y<z"]
    for t in hard:
        assert np.frombuffer(enc.encode([t.encode()])[0], "<u2").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_words_are_those_of_split():
    rng = random.Random(3)
    alphabet = [b"a", b"B", b"\xc3\xa9", b" ", b"\n", b"\x0b", b"\x1c", b".", b"'", b"\x00", b"q" * 70]
    some = [b"".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(300)]
    w = words.Words(some)
    assert [[w.of(k) for k in range(a, b)] for a, b in zip(w.cut, w.cut[1:])] == [t.lower().split() for t in some]
    named = {w.of(k): int(x) for k, x in enumerate(w.key)}
    assert len(set(named.values())) == len(named) and all(words.key(x) == k for x, k in named.items())
    assert b"".join(x for _, run in words.chunks(some, 50) for x in run) == b"".join(some)


def test_tables_of_words():
    key = np.unique(np.random.default_rng(2).integers(1, 1 << 63, 20_000).astype(np.uint64))
    t = words.Table(4)
    for at in range(0, len(key) // 2, 1000):
        t.add(key[at : min(at + 1000, len(key) // 2)], np.arange(at, min(at + 1000, len(key) // 2), dtype=np.int32))
    found = t.find(key)
    assert found[: len(key) // 2].tolist() == list(range(len(key) // 2)) and (found[len(key) // 2 :] == -1).all()


def test_a_full_table_starts_anew(monkeypatch):
    enc, small = tokens.Encoder(tokens.tokenizer_path(tokenfile.TOKENIZER)), [b"one two three", b"four two! five", b"two one six"]
    expect = [enc._encode([t], b"") for t in small]
    monkeypatch.setattr(tokens, "CACHE", 2)
    assert [enc._encode([t], b"") for t in small] == expect


# 9


def expect_base(rows, held):
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out[d] = (held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("head", [200_000, 50])
def test_base_scores(monkeypatch, docs, small, awkward, head):
    monkeypatch.setattr(suffixtree, "HEAD", head)  # rare words meet their counts by the join
    for df, rows in ((docs, small), (awkward, texts(AWKWARD))):
        want = expect_base(rows, is_held)
        got = suffixtree.score_documents(df, suffixtree.held_out()).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))


def test_runs_go_in_packed_pieces():
    """Of 3,000 runs no row of a shuffle is made, one of each piece; a piece has all of a key, and a run's start is told from its key."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 3000), dtype=np.uint64) * np.uint64(2)
    key, n = suffixtree.run_key(a, b), rng.integers(1, 9, 3000)
    batches = [x for some in (slice(0, 2000), slice(1000, 3000)) for x in suffixtree._dealt(key[some], [b[some], n[some].view(np.uint64)], 2)]
    assert sum(x.num_rows for x in batches) == 2 * 2 * suffixtree.PIECES
    got, pieces = {}, list(suffixtree._taken(batches, 3))
    for k, b_, m in pieces:
        k, (b_,), m = suffixtree._merged(k, [b_], m.view(np.int64))
        assert not got.keys() & set(k.tolist())
        got |= dict(zip(k.tolist(), zip(suffixtree._start_of(k, b_).tolist(), b_.tolist(), m.tolist())))
    twice = np.where((np.arange(3000) >= 1000) & (np.arange(3000) < 2000), 2, 1)
    assert len(pieces) == 2 * suffixtree.PIECES and got == dict(zip(key.tolist(), zip(a.tolist(), b.tolist(), (n * twice).tolist())))


def test_tree_beats_its_root(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        w = ["a"]
        while len(w) < 40:
            w.append({"a": "b", "b": "c", "c": "a"}[w[-1]] if rng.random() < 0.8 else str(rng.choice(["a", "b", "c", "d"])) if w[-1] in "abc" else "a")
            if w[-1] == "d":
                w.append("a")
        rows.append((k, " ".join(w)))
    got = suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffixtree.held_out()).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def expect_scores(rows, held):
    """(scores, nodes, prob) by dictionaries: every context and next symbol of all words, by the rules of the module."""
    train = [[*(t or "").encode().lower().split(), None] for d, t in rows if not held(d)]
    one = Counter(x for w in train for x in w)
    total, unit = sum(one.values()), sum(one.values()) + len(one) + 1
    nodes = {}

    def prob(ctx, x):
        if not ctx:
            return (one[x] + 1) / unit
        if ctx not in nodes:
            return prob(ctx[1:], x)
        return nodes[ctx][1].get(x) or nodes[ctx][0] * prob(ctx[1:], x)

    for k in range(1, suffixtree.DEPTH + 1):
        after = {}
        for w in train:
            for i in range(k, len(w)):
                ctx = tuple(w[i - k : i])
                if k == 1 or ctx[1:] in nodes:
                    after.setdefault(ctx, Counter())[w[i]] += 1
        found = {}
        for ctx, c in after.items():
            m, seen = sum(c.values()), {x: n for x, n in c.items() if n >= suffixtree.MIN_COUNT}
            q = {x: prob(ctx[1:], x) for x in seen}
            rest_p, rest_q = max(1 - sum(seen.values()) / m, 0), max(1 - sum(q.values()), 1e-12)
            kl = sum(n / m * math.log(n / m / q[x]) for x, n in seen.items()) + (rest_p * math.log(rest_p / rest_q) if rest_p > 0 else 0)
            if seen and kl * m > 0.5 * math.log(total) * len(seen):
                d = {x: (n - suffixtree.DISCOUNT) / m for x, n in seen.items()}
                found[ctx] = (max(1 - sum(d.values()), 1e-12) / rest_q, d)
        if not found:
            break
        nodes |= found

    def state(w, i):
        return next((w[i - k : i] for k in range(min(i, suffixtree.DEPTH), 0, -1) if all(tuple(w[i - j : i]) in nodes for j in range(1, k + 1))), [])

    out = {}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out[d] = sum(math.log10(prob(tuple(state(w, i)), x)) for i, x in enumerate(w))
    unseen = 1 - sum((n + 1) / unit for n in one.values())
    for ctx in nodes:  # a node's probabilities, and what the root leaves for unseen symbols as it reaches the node, sum to 1
        factor = math.prod(nodes[ctx[k:]][0] for k in range(len(ctx)))
        assert abs(sum(prob(ctx, x) for x in one) + factor * unseen - 1) < 1e-6
    return out, nodes


@pytest.mark.parametrize("bound", [250_000, 20])
def test_scores_are_brute_force(monkeypatch, docs, small, awkward, bound):
    monkeypatch.setattr(suffixtree, "NODES", bound)  # most of the tree is met by the join
    monkeypatch.setattr(suffixtree, "HELD", 1000 * bound)
    for df, rows in ((docs, small), (awkward, texts(AWKWARD))):
        want, nodes = expect_scores(rows, is_held)
        assert df is awkward or {len(c) for c in nodes} >= {1, 2}
        for r in suffixtree.score_documents(df, suffixtree.held_out()).collect():
            assert abs(r.score - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id]))


def test_deep_contexts(spark):
    """Symbols that only the five words before tell."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        w = []
        for _ in range(12):
            x = rng.integers(0, 2, 5)
            w += [f"p{j}" for j in x] + [f"q{int(x.sum() % 2)}"]
        rows.append((k, " ".join(w)))
    want, nodes = expect_scores(rows, is_held)
    assert max(map(len, nodes)) >= 3
    for r in suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffixtree.held_out()).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id]))


def test_rare_contexts_stay_in_the_tree(spark):
    rows = [(k, " ".join(f"c{(k * j) % 97}" for j in range(400))) for k in range(1, 701)]
    rows += [(1000 + k, "zig zag zog") for k in range(8)]  # their share of 280,000 tokens is below 5e-5
    got = {r.doc_id: r for r in suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), suffixtree.held_out()).collect()}
    assert got[1000].score > 0.5 * got[1000].base_score


def test_scores_of_empty_tables(empty):
    assert suffixtree.score_documents(empty, suffixtree.held_out()).collect() == []


# 3


def expect_near(ids, v, queries, k):
    out = {}
    for q in queries:
        s = v @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = expect_near(ids, v, np.flatnonzero(ids % 20 == 0), 20)
    got: dict = {}
    for r in sorted(ivfpq.op3_ivfpq(spark, data).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(1)
    one = [float(x) for x in rng.normal(size=6)]
    rows = [(k, one) for k in range(60)] + [(100 + k, [float(x) for x in rng.normal(size=6)]) for k in range(30)]
    bad = [(200, None), (201, [0.0] * 6), (220, [float("nan")] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("inf")] + [0.0] * 5), (280, [1.0]), (None, one)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ivfpq.search(df, df["vec_id"] % 20 == 0).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == list(range(1, 21)) and by[20] == list(range(20)) and by[40] == list(range(20))  # ties to smaller ids
    assert set(by) == {0, 20, 40, 100, 120}
    assert ivfpq.search(df.limit(0), df["vec_id"] % 20 == 0).collect() == []
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in sorted(ivfpq.search(few, few["vec_id"] == 0).collect(), key=lambda r: r.rank)] == [1, 2, 3, 4]


def test_neighbours_of_repeated_ids(spark):
    rows = [(20, [1.0, 2.0]), (1, [0.5, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])]
    lists = lambda rows: sorted(tuple(r) for r in ivfpq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect())
    assert lists(rows) == [(20, 1, 1, 5.0), (20, 2, 2, 3.0), (20, 3, 1, 2.5)]
    assert lists([*rows, (20, [2.0, 2.0])]) == [(20, 1, 1, 5.0), (20, 1, 1, 8.0), (20, 2, 2, 3.0), (20, 2, 2, 4.0), (20, 3, 1, 2.5), (20, 3, 1, 3.0)]
    rng = np.random.default_rng(4)
    many = [(int(i), [float(x) for x in rng.integers(-3, 4, 3)]) for i in rng.integers(0, 40, 120)]
    want = []
    for i, v in {(i, tuple(v)) for i, v in many if i % 20 == 0 and any(v)}:
        near = sorted((-float(np.dot(v, w)), j) for j, w in many if j != i and any(w))[:20]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    assert lists(many) == sorted(want)


@pytest.mark.parametrize("kind", ["clusters", "queries"])
def test_neighbours_of_other_vectors_are_all_found(spark, kind):
    rng = np.random.default_rng(7)
    ids = np.arange(4000)
    v = rng.normal(size=(len(ids), 32))
    if kind == "clusters":
        v = (3 * rng.normal(size=(100, 32)))[rng.integers(0, 100, len(ids))] + 0.3 * v
    else:  # queries unlike the rest, and lengths that differ
        v *= rng.lognormal(size=len(ids))[:, None]
        v[ids % 200 == 0] = rng.normal(size=(20, 32)) * np.r_[np.full(4, 8.0), np.full(28, 0.1)]
    df = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(ids, v)], "vec_id long, embedding array<double>")
    want = expect_near(ids, v, np.flatnonzero(ids % 200 == 0), 20)
    got: dict = {}
    for r in sorted(ivfpq.search(df, F.col("vec_id") % 200 == 0, sample=500).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in x] for q, x in want.items()}


# 10


def test_mixture_meets_its_targets(docs):
    from pyspark.sql import functions as F

    got = mixture.probabilities(docs, sweeps=30)
    total = got.agg(F.sum("_tokens")).first()[0]
    for c, power in (("source", 0.7), ("lang", 0.7)):
        have = got.groupBy(c).agg(F.sum("_tokens").alias("t"), F.sum(F.col("_tokens") * F.col("_weight")).alias("w")).collect()
        scale = sum(r.t**power for r in have)
        for r in have:
            assert abs(r.w / total - r.t**power / scale) < 0.01
    assert got.filter("_probability > 1 OR _probability < 0").count() == 0


def test_mixture_awkward(awkward, empty):
    got = mixture.probabilities(awkward).collect()
    assert len(got) == len(AWKWARD) and {r._topic for r in got if not r.text} == {"none"}
    assert mixture.mix(awkward).columns == awkward.columns
    assert mixture.mix(empty).collect() == []


# queries, twins and the pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twins(spark, data, name):
    assert rows_of(registry.QUERIES[name](spark, data)) == rows_of_sql(connect(data), registry.ORACLE[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark, data, docs):
    df, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, data)
        seen.append(df.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == docs.columns
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 0
    assert corpus_pipeline.run(spark, data).count() == seen[-1]


INNER = "own _topic _TOKENS _weight _Probability _selected _source _lang topic tokens Lang_Pred SCORE spans Items N_words _row _D _h root fp n m component_id a.b".split()


def test_other_columns_pass_untouched(spark, data):
    words_of = lambda k: " ".join(f"{w}{k}" for w in "the cat sat on the mat and the dog ran off".split())
    rows = [(k, words_of(k % 7) + " and then home", "en", "s") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"own {c} "), F.col("doc_id")) for c in INNER})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, data)
        got = out.collect()
        assert out.columns == df.columns and got
        for r in got:
            assert list(r) == [*rows[r.doc_id], *(f"own {c} {r.doc_id}" for c in INNER)]
    items = spark.createDataFrame([("1", words_of(3)), ("2", words_of(5))], "item_id string, text string")
    found = decontaminate.overlaps(df, items, group_mb=5e-5, keep=("doc_id", "_row")).collect()
    assert all(r._row == f"own _row {r.doc_id}" and r["items"] == {3: ["1"], 5: ["2"]}.get(r.doc_id % 7, []) for r in found) and len(found) == 20


def test_settings_stay(spark, data):
    common.shared_dir(spark)  # sets spark.checkpoint.dir where it isn't, as in tests
    before, tables = dict(spark.conf.getAll), spark.catalog.listTables()
    for name, query in registry.QUERIES.items():
        query(spark, data)
        assert dict(spark.conf.getAll) == before, name
    assert spark.catalog.listTables() == tables


def test_pipeline_awkward(spark, data, awkward, empty):
    for start in (awkward, empty):
        df = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(spark, df, data)
            if k < 4:
                assert df.columns == start.columns
        df.collect()
