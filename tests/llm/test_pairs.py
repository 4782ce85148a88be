"""Near-duplicate classes, repeated strings and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import dart_minhash, suffix_dedup
from strandlog.llm.dart_minhash import changes, links_between, near_classes, signatures
from strandlog.llm.imatch import LOW, imatch, lexicon
from strandlog.llm.shingles import folded, multiset, shingle_hashes, weighted_jaccard
from strandlog.llm.suffix_dedup import removed_spans, repeats_digest

WORDS = [f"w{k}" for k in range(3000)]


def text_of(draw, n):
    return " ".join(draw.choices(WORDS, k=n))


def edited(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = draw.choice(WORDS)
    return " ".join(words)


def corpus(seed=3):
    draw = random.Random(seed)
    texts = [text_of(draw, draw.choice([1, 3, 8, 60, 150, 400])) for _ in range(60)]
    for base in (text_of(draw, 150), text_of(draw, 300)):
        texts += [base] * 4 + [edited(draw, base, draw.randrange(1, 9)) for _ in range(40)]
    passage = text_of(draw, 60)
    texts += [f"{text_of(draw, 40)} {passage} {text_of(draw, 40)}" for _ in range(12)]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [4096, 7])
def test_near_classes(spark, monkeypatch, block):
    monkeypatch.setattr(dart_minhash, "BLOCK_ROWS", block)
    texts = corpus()
    sets = [multiset(folded(t)) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_classes(docs).collect()} == {k: root(k) for k in range(len(texts))}


def test_links_between():
    draw = random.Random(13)
    base = text_of(draw, 100)
    lead = multiset(folded(base))
    texts = [edited(draw, base, draw.randrange(1, 9)) for _ in range(30)]
    texts += [edited(draw, t, 1) for t in texts[:10]]
    sets = [multiset(folded(t)) for t in texts]
    rows = [(k, int(m[1].sum()), k % 37, changes(m, lead).view(np.int64)) for k, m in enumerate(sets)]
    expected = {(i, rows[j][2]) for i in range(40) for j in range(40) if rows[i][2] != rows[j][2] and weighted_jaccard(sets[i], sets[j]) >= 0.8}
    assert {(i, rows[j][2]) for i, j in links_between(rows, rows, 0.8)} == expected and expected


def test_signatures_agree_as_often_as_the_similarity():
    draw = random.Random(5)
    a = text_of(draw, 400)
    pair = [folded(a), folded(edited(draw, a, 12)), b"be " * 50]
    h, owner = shingle_hashes(pair)
    s = signatures(h, owner, 3, 2000)
    assert abs((s[0] == s[1]).mean() - weighted_jaccard(multiset(pair[0]), multiset(pair[1]))) < 0.05
    alone = signatures(*shingle_hashes(pair[1:2]), 1, 2000)
    assert (alone[0] == s[1]).all()
    assert (s != np.iinfo(np.uint64).max).all()


def test_changes_are_symmetric_differences():
    a, b, c = (multiset(folded(t)) for t in ("x y z v w u a b c d", "x y z v w u", "x y z v w u a b c e"))
    da, dc = set(changes(a, b).tolist()), set(changes(c, b).tolist())
    assert len(da ^ dc) == int(a[1].sum() + c[1].sum()) - 2 * len(set(a[0].tolist()) & set(c[0].tolist()))


def brute_repeats(texts, length):
    raws = [t.encode() for t in texts]
    counts = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(r, cover, strict=True) if not c)
        out.append((len(r), sum(cover), sum(cover[k] and not (k and cover[k - 1]) for k in range(len(r))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [1 << 22, 333])
def test_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "PART_RANKS", piece // 2)
    texts = [*corpus(7), "ab" * 300, "ab" * 99 + "é" * 200, "x" * 199, "x" * 200, "é" * 100]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats_digest(docs).collect()}
    assert [found[k] for k in range(len(texts))] == brute_repeats(texts, 200)


def test_pieces_choose_the_same_positions():
    draw = np.random.default_rng(3)
    for n in (200, 201, 299, 300, 1000, 1999, 2000, 2345):
        raw = draw.integers(97, 100, n).astype(np.uint8)
        h = suffix_dedup.half_ranks(raw, 100)
        whole = suffix_dedup.thinned(h, 100, 200)
        for piece in (1, 50, 333, 1000, 5000):
            parts = list(suffix_dedup.thinned_ranks(raw, 100, 200, piece))
            assert np.concatenate([p[0] for p in parts]).tolist() == whole.tolist()
            assert (np.concatenate([p[1] for p in parts]) == h[whole]).all() and min(p[2] for p in parts) == h.min()


def test_names_that_share_a_half():
    one, two = np.array([5, 5, 5, 7], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint32)
    a, b, counts, place = suffix_dedup.distinct_names(one, two)
    assert (a.tolist(), b.tolist(), counts.tolist(), place.tolist()) == ([5, 5, 7], [1, 2, 1], [2, 1, 1], [0, 1, 0, 2])
    packs = [np.array(x[:2], dtype=np.uint64).tobytes() + np.array(x[2:], dtype=np.uint32).tobytes() for x in ([5, 7, 1, 1], [5, 8, 2, 1], [7, 9, 1, 1])]
    flags = suffix_dedup.repeated_names(packs, [b"\x00", b"\x40", b"\x00"])
    assert [np.unpackbits(np.frombuffer(f, dtype=np.uint8), count=2).tolist() for f in flags] == [[0, 1], [0, 1], [1, 0]]


def test_a_very_long_text(spark):
    draw = np.random.default_rng(4)
    passage = "".join(map(chr, draw.integers(97, 123, 5_000)))
    long = "".join(map(chr, draw.integers(97, 123, 30_000_000)))
    rows = [(1, long[:20_000_000] + passage + long[20_000_000:]), (2, f"a {passage} b"), (3, None)]
    found = {r["doc_id"]: r for r in repeats_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1]["n_bytes"] == 30_005_000 and (found[1]["n_removed"], found[1]["n_spans"], found[2]["n_removed"]) == (5_000, 1, 5_000)
    assert found[1]["kept_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_spans():
    parts = [removed_spans(np.array(x), 10) for x in ([0, 3], [10, 21], [22, 40])]
    assert suffix_dedup.joined_spans(parts).tolist() == [[0, 20], [21, 32], [40, 50]]

    assert removed_spans(np.array([0, 3, 10, 21]), 10).tolist() == [[0, 20], [21, 31]]
    assert removed_spans(np.array([], dtype=np.int64), 10).tolist() == []


def test_imatch(spark):
    texts = corpus(11)
    ids = random.Random(1).sample(range(10_000), len(texts))
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r for r in imatch(rows, low=0.0, high=0.2).collect()}
    order = sorted(ids)
    of = dict(zip(ids, texts, strict=True))
    for k, i in enumerate(order):
        text, following = of[i], of[order[(k + 1) % len(order)]]
        m = len(text) // 4
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest()
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    by_text = {}
    for i in ids:
        assert by_text.setdefault(of[i], found[i]["fingerprint"]) == found[i]["fingerprint"]
    long = [found[i] for i in ids if len(of[i]) > 300]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)


@pytest.mark.parametrize("ids", ["wide", "hot", "null", "mixed"])
def test_imatch_finds_the_next_document(spark, ids):
    draw = random.Random(22)
    n = 300
    made = {
        "wide": [-(2**62) - 5, 2**62 + 5, *(draw.randrange(-(2**63), 2**63) for _ in range(n - 4)), 2**63 - 1, -(2**63)],
        "hot": [7] * 150 + list(range(1000, 1000 + n - 150)), "null": [None] * 200 + draw.sample(range(10**6), n - 200), "mixed": [None] * 60 + [5] * 120 + draw.sample(range(1000), n - 180),
    }[ids]
    rows = [(i, f"text {k} {text_of(draw, draw.randrange(0, 9))}") for k, i in enumerate(made)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    expected = []
    for k, (i, t) in enumerate(order):
        m = len(t) // 4
        expected.append((i, hashlib.sha256((t[: len(t) - m] + order[(k + 1) % n][1][:m]).encode()).hexdigest()))
    found = [(r["doc_id"], r["edited_sha256"]) for r in imatch(docs).select("doc_id", "edited_sha256").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_imatch_copies_leave_the_lexicon_alone(spark):
    draw = random.Random(16)
    texts = [text_of(draw, 60) for _ in range(150)]
    lexicon_of = lambda ts: lexicon(spark.createDataFrame([(t,) for t in ts], "text string"), F.col("text"), 0.0, 0.02)
    assert lexicon_of(texts) == lexicon_of(texts + texts[:1] * 70 + texts[1:40])


def test_imatch_grades_texts_without_lexicon_terms(spark):
    draw = random.Random(17)
    own = [f"own{k}" for k in range(200)]
    rows = [(k, text_of(draw, 60)) for k in range(150)] + [(1000, " ".join(own)), (1001, " ".join(own[:150] + [f"other{k}" for k in range(50)])), (1002, text_of(draw, 60))]
    found = {r["doc_id"]: r for r in imatch(spark.createDataFrame(rows, "doc_id bigint, text string"), low=0.02, high=0.05).collect()}
    assert found[1000]["fingerprint"].startswith("x") and found[1001]["fingerprint"].startswith("x")
    assert 0.3 < found[1000]["near_edited"] < 1 and 0 < found[1000]["near_next"] < 1
    assert 0 < found[1001]["near_edited"] < 1 and found[1001]["near_next"] == 0


def test_imatch_lexicon_stays_out_of_the_plan(spark):
    assert LOW == 0.001
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(corpus(18))], "doc_id bigint, text string")
    plan = imatch(docs, low=0.0, high=0.2)._jdf.queryExecution().toString()
    assert not any(str(h) in plan for h in lexicon(docs, F.col("text"), 0.0, 0.2)[100:200])
