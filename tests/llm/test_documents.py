"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import backoff_lm, best_fit_packing, common, minhash_dedup, quality_rules, text_sketch, toxicity, unigram_pieces

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(seed: int = 1) -> list[tuple]:
    """Texts with groups of near copies, exact copies, nulls, empty and short ones, and one very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out: list[str | None] = [None, "", "   \n\t", "One", "one", "two words", "A b\x1cc d e", "tail\n\n", text(30_000)]
    for _ in range(12):
        base = text(rng.randint(20, 120)).split()
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((" " if rng.random() < 0.5 else "\n").join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    out += [text(rng.randint(1, 60)) for _ in range(30)]
    return [(i * 3 + 1, t, "x", i, "clash") for i, t in enumerate(out)]


SCHEMA = "doc_id long, text string, id string, n int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5)


def shingles(text: str | None, n: int) -> set:
    w = WORD.findall((text or "").encode().lower())
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows, n: int, percent: int) -> dict:
    sets = {r[0]: shingles(r[1], n) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, docs, n, percent):
    got = minhash_dedup.near_duplicates(docs, minhash_dedup.Policy(n, percent)).collect()
    assert {r.id: (r.n, r.component) for r in got} == linked(documents(), n, percent)
    small = minhash_dedup.near_duplicates(docs, minhash_dedup.Policy(n, percent, block=2)).collect()
    assert sorted(small) == sorted(got), "blocks of two sets must lose no link"


def test_near_duplicates_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (8, None)], "doc_id long, text string")
    got = sorted(((r.id, r.n, r.component) for r in minhash_dedup.near_duplicates(odd, minhash_dedup.Policy(3, 85)).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (8, 0, 8)], key=str)
    kept = minhash_dedup.deduplicated(odd).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "a b c d"), (5, "a b c d"), (8, None)], key=str)
    empty = odd.where("false")
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.deduplicated(empty).count() == 0


def test_without_a_filter_all_texts_move_and_no_link_is_lost(spark, docs):
    old, common.Bloom.MOST = common.Bloom.MOST, 1
    try:
        got = minhash_dedup.near_duplicates(docs, minhash_dedup.Policy(3, 85)).collect()
        kept = minhash_dedup.deduplicated(docs, minhash_dedup.Policy(3, 85))
    finally:
        common.Bloom.MOST = old
    expected = linked(documents(), 3, 85)
    assert {r.id: (r.n, r.component) for r in got} == expected
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_clashing_column_names(spark, docs):
    from pyspark.sql import functions as F

    taken = docs.withColumns({c: F.lit("mine") for c in ("__id", "__text", "id", "text_hash", "stats", "__stats", "id_", "Stats_")})
    labels = spark.createDataFrame([(i * 3 + 1, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (minhash_dedup.deduplicated(taken), quality_rules.kept(taken, labels, 0.0), toxicity.clean(taken, labels, 1.1)):
        assert out.columns == taken.columns
        assert {tuple(r) for r in out.select("__id", "__text", "id", "stats", "Stats_").distinct().collect()} == {("mine",) * 5}


def test_components_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(9, 9)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{i: 5000 for i in range(5000, 5201)}}


def test_match_threshold_misses_few():
    p = minhash_dedup.Policy(3, 85)
    assert sum(math.comb(p.k, i) * 0.85**i * 0.15 ** (p.k - i) for i in range(p.threshold)) <= p.miss


def test_packing_is_whole_and_tight(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "x"), (1, "a <|endoftext|> b"), (1, "a <|endoftext|> b")], "doc_id long, text string"))
    rows = best_fit_packing.packed(odd, path, 256).collect()
    expected = Counter()
    for r in odd.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start : start + 256], "<u4")
            expected[r.doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.01 * sum(r.length for r in rows) / 256 + 2
    assert best_fit_packing.packed(odd.where("false"), path, 256).count() == 0


def test_chunk_ids_equal_the_tokenizer():
    """Cuts, marks, case, other alphabets, special tokens, and a memo emptied all the time."""
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, memo = Tokenizer.from_file(path), best_fit_packing.ChunkIds(path)
    rng = random.Random(4)
    signs = ["a", "b", "th", "ing", "É", "ß", "ÿ", "×", "e\u0301", "\u0301", "'s", "'", "9", ".", "!!", "…", "“", "?", "|", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "ﬁ", "日本", "🙂", "\0", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["x" * 5000, "word " * 3000]
    for bits in (21, 6):
        memo.BITS = bits
        memo.reset()
        for start in range(0, len(texts), 100):
            part = texts[start : start + 100]
            for text, ids in zip(part, memo.of([x.encode() for x in part]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_cut_and_joined():
    texts = [(k, x) for k, x in enumerate([b"", b"ab cd  ef gh" * 9, b"x" * 50, b"a b"])]
    for size in (1, 7, 20, 1000):
        got: dict = {}
        for group in common.cut(iter(texts), b" ", size):
            for key, number, piece in group:
                assert number == 0 or piece.startswith(b" ")
                got[key] = got.get(key, b"") + piece
        assert got == dict(texts)


def test_two_documents_replace_the_smallest():
    # filling greedily gives 6 + 3 and leaves a gap of 1; 2 + 2 fill the place of 3 and the gap
    patterns = best_fit_packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert ([6, 2, 2], 1) in patterns
    counts = Counter()
    for lengths, times in best_fit_packing.best_two_fit({n: n % 7 + 1 for n in range(1, 100)}, 100):
        assert sum(lengths) <= 100
        for n in lengths:
            counts[n] += times
    assert counts == Counter({n: n % 7 + 1 for n in range(1, 100)})


def test_sketches(spark, docs):
    rows = documents()
    got = {r.doc_id: r for r in text_sketch.fingerprinted(docs).collect()}
    memo = text_sketch.WordHashes()
    for k, (i, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (set(text_sketch.digests(x, memo).tolist()) for x in (text, new, after))
        for near, other in ((r.near_edited, b), (r.near_next, c)):
            assert near == pytest.approx(2 * len(a & other) / (len(a) + len(other)) if a or other else 1)
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)
    one = text_sketch.fingerprinted(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert text_sketch.fingerprinted(docs.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "p"), (2, "q r"), (2, "q r"), (None, None)], "doc_id long, text string")
    assert text_sketch.fingerprinted(nulls).count() == 4


def test_small_tables_fail_and_larger_ones_peel():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    b = np.concatenate([a[:2500], np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))])
    made = text_sketch.Tables.empty(1, text_sketch.CELLS)
    made.add(a, np.zeros(len(a), int), np.ones(len(a), int))
    made.add(b, np.zeros(len(b), int), -np.ones(len(b), int))
    assert not made.peeled(1)[3][0]
    assert text_sketch.likeness([a], [b])[0] == pytest.approx(2 * 2500 / (len(a) + len(b)))
    keys, pair, sign = text_sketch.differences([a, a, b[:3]], [b, a, b[:0]])
    for k, x, y in ((0, a, b), (1, a, a), (2, b[:3], b[:0])):
        assert np.array_equal(np.sort(keys[(pair == k) & (sign > 0)]), np.setdiff1d(x, y))
        assert np.array_equal(np.sort(keys[(pair == k) & (sign < 0)]), np.setdiff1d(y, x))


def test_language_model_equals_a_plain_one(spark, docs):
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "One two"), (4, ""), (4, "")], "doc_id long, text string"))
    rows = [(r.doc_id, [*WORD.findall((r.text or "").encode().lower()), b" end "]) for r in odd.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    training = [w for i, w in rows if not held(i)]
    c1, c2 = Counter(x for w in training for x in w), Counter(p for w in training for p in zip([w[-1], *w], w))
    n, v, k = sum(c1.values()), len(c1), backoff_lm.PRIOR
    expected = []
    for i, w in rows:
        base = score = 0.0
        for before, x in zip([w[-1], *w], w):
            p = (c1[x] + 1) / (n + v + 1)
            base += math.log10(p)
            score += math.log10((c2[before, x] + k * p) / (c1[before] + k)) if c1[before] else math.log10(p)
        expected.append((str(i), held(i), len(w), sum(c1[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    old, backoff_lm.BLOCK, backoff_lm.PART = (backoff_lm.BLOCK, backoff_lm.PART), 500, 3000
    try:
        got = backoff_lm.scored(odd).collect()
    finally:
        backoff_lm.BLOCK, backoff_lm.PART = old
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == sorted(expected)
    assert backoff_lm.scored(docs.where("false")).count() == 0


def test_traversal_carries_its_state():
    uni, context, word, bi = np.array([3.0, 2.0, 0.0]), np.array([0, 0, 1, 2]), np.array([0, 1, 2, 0]), np.array([1.0, 2.0, 0.0, 0.0])
    a = backoff_lm.Automaton(uni, context, word, bi, 5, 2)
    rng = np.random.default_rng(3)
    lengths = np.array([1, 700, 3, 1024, 512, 2])
    starts, tokens = np.cumsum(lengths) - lengths, rng.integers(0, 3, lengths.sum())
    before = np.concatenate(([0], tokens[:-1]))
    before[starts] = 1
    expected = []
    for s, n in zip(starts, lengths):
        state, total = a.state[[1]], 0.0
        for w in tokens[s : s + n]:
            state, weight = a.step(state, np.array([w]))
            total += weight[0]
        expected.append(total)
    assert a.traversed(tokens, starts, lengths, before) == pytest.approx(expected)
    # in a context the words and one unknown word share all probability
    full = backoff_lm.Automaton(uni[:2], np.array([0, 0]), np.array([0, 1]), np.array([1.0, 2.0]), 5, 2)
    _, weights = full.step(np.array([1, 1]), np.array([0, 1]))
    unknown = full.failure[1] + math.log10(1 / (5 + 2 + 1))
    assert sum(10**x for x in weights) + 10**unknown == pytest.approx(1)


def test_pieces_equal_the_library(spark, docs):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram_pieces.Pieces(path)
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.score < unigram_pieces.NEVER:
            p.score = pieces.unknown + unigram_pieces.UNKNOWN
    library = SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    encoder = unigram_pieces.Encoder(pieces)
    extra = ["a  b   c ", " lead", "\n\nx\ty", "门 含 ข 😀", "é ê ﬁ", "", "x" * 300, "日本語の文" * 80, "tail  "]
    texts = [*(r[1] or "" for r in documents()[:60]), *extra, "a\0b c", "x▁y"]
    for encode in (encoder, unigram_pieces.Encoder(pieces)):
        for text, (_, ids, score, fallen, back, same) in zip(texts, unigram_pieces.results(((None, x.encode()) for x in texts), encode), strict=True):
            plain = encode.best(b" " + text.replace("▁", " ").encode()) if text else (np.zeros(0), 0.0, 0)
            assert ids.tolist() == plain[0].tolist() and score == pytest.approx(plain[1]) and fallen == plain[2]
            assert same == ("▁" not in text) and back.decode() == text.replace("▁", " ")
            if text not in ("a\0b c", "x▁y"):
                assert ids.tolist() == library.encode(text)
        encode.BITS = 8  # the second time with a table that is emptied and widened all the time
        encode.reset()
    got = {r.doc_id: r for r in unigram_pieces.encoded(docs, path).collect()}
    assert len(got) == len(documents()) and all(r.round_trip for r in got.values()) and got[1].n_pieces == 0
    assert unigram_pieces.encoded(docs.where("false"), path).count() == 0


def _held_out(spark, scored, label, threshold):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.join(labels, scored["id"] == labels["doc_id"]).where("held_out").select("score", label).collect()
    return np.array([(r[0] >= threshold, r[1]) for r in rows], int).T


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    predicted, truth = _held_out(spark, quality_rules.scored(docs, labels), "quality", 0.3)
    assert (predicted == truth).mean() > 0.98 and predicted[truth == 1].mean() > 0.99


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    predicted, truth = _held_out(spark, toxicity.scored(docs, labels), "toxic", 0.7)
    assert predicted[truth == 1].mean() > 0.8 and predicted[truth == 0].mean() < 0.01


def test_classifiers_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i * 3 + 1, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (4, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for module, keep in ((quality_rules, quality_rules.kept), (toxicity, toxicity.clean)):
        scored = module.scored(docs, labels).collect()
        assert len(scored) == len(documents()) and all(0 <= r.score <= 1 for r in scored)
        constant = module.scored(docs, labels.where("false")).select("score").distinct().collect()
        assert len(constant) == 1
        assert module.scored(docs.where("false"), labels).count() == 0
        assert keep(docs, labels).columns == docs.columns


def test_rules_as_columns_equal_rules_on_arrays(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality_rules.NAMES)))
    model = quality_rules.fitted(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float))
    z = model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, stats array<double>")
    got = [r.p for r in df.select("i", model.score(F.col("stats")).alias("p")).orderBy("i").collect()]
    assert model.rules and got == pytest.approx((1 / (1 + np.exp(-z))).tolist())
