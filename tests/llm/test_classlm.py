import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkpanel.llm import classlm


def base(rows):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((i if i is not None else -1, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows)


def same(got, want):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("tokens", [classlm.CHUNK_TOKENS, 20_000])
def test_base_is_exact_and_model_beats_it(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = classlm.score(docs, tokens).collect()
    print(*(sum(r[k] for r in got if r.held_out) for k in ("score", "base_score")))
    same(got, base(rows))
    for held in (True, False):
        assert sum(r.score for r in got if r.held_out == held) > 0.98 * sum(r.base_score for r in got if r.held_out == held)


def plain_scores(rows, sweeps=classlm.SWEEPS):
    """The model's log10 probability of each text, by dictionaries and loops."""
    end, k = b"", classlm.CLASSES
    texts = [(i, (t or "").encode().lower().split() + [end]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    learn = [w for i, w in texts if not held(i)]
    count = Counter(w for words in learn for w in words)
    number = lambda w: xxhash.xxh3_64_intdigest(w)
    signed = lambda w: number(w) - (1 << 64) * (number(w) >= 1 << 63)
    top = sorted(count, key=lambda w: (-count[w], signed(w)))[: k - 1]
    klass = {w: top.index(w) if w in top else k - 1 for w in count}

    def pairs():
        for words in learn:
            yield from zip([end, *words[:-1]], words, strict=True)

    def matrix():
        out = np.zeros((k, k))
        for a, b in pairs():
            out[klass[a], klass[b]] += 1
        return out

    now = matrix()
    levels = [classlm.likelihood(now)]
    for _ in range(sweeps):
        gain = np.zeros((2, k, k))
        for c, d in itertools.product(range(k), repeat=2):
            size = math.log(now[:, d].sum() + now[d].sum() + 0.2 * k)
            gain[0, c, d], gain[1, c, d] = math.log(now[c, d] + 0.1) - size, math.log(now[d, c] + 0.1) - size
        votes = {w: np.zeros(k) for w in count}
        for words in learn:
            for a, b in zip([end, *words[:-1]], words, strict=True):
                votes[b] += gain[0, klass[a]]
            for a, b in zip(words[:-1], words[1:], strict=True):
                votes[a] += gain[1, klass[b]]
        klass = {w: int(v.argmax()) for w, v in votes.items()}
        now = matrix()
        levels.append(classlm.likelihood(now))
    n, v, size = sum(count.values()), len(count), now.sum(0)
    unknown, used = 0.5 / (n + 0.5 * (v + 1)), size > 0

    def probability(before, w):
        base = (count[w] + 0.5) / (n + 0.5 * (v + 1))
        if w not in count:
            return base
        row = now[klass[before]] if before in count else size
        move = (row[klass[w]] + 0.5) / (row.sum() + 0.5 * used.sum())
        return classlm.MIX * (1 - unknown) * move * count[w] / size[klass[w]] + (1 - classlm.MIX) * base

    scores = [(i, sum(math.log10(probability(a, b)) for a, b in zip([end, *words[:-1]], words, strict=True))) for i, words in texts]
    return scores, levels, probability, count


def test_score_is_that_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, levels, probability, count = plain_scores(rows)
    assert levels == sorted(levels)  # so no sweep was given up
    got = {r.doc_id: r.score for r in classlm.score(spark.createDataFrame(rows, "doc_id long, text string"), 5_000).collect()}
    for i, x in want:
        # sums of floats in another order may settle a tie between classes otherwise
        assert got[i] == pytest.approx(x, rel=1e-3)
    assert sum(got.values()) == pytest.approx(sum(x for _, x in want), rel=1e-4)
    for before in [*list(count)[:5], b"", b"never seen"]:
        assert sum(probability(before, w) for w in [*count, b"never seen"]) == pytest.approx(1, abs=1e-9)


def test_probabilities_sum_to_one():
    klass, total = np.array([0, 0, 1, 1, 2, -1], np.int8), np.array([5, 3, 4, 2, 6, 0], np.uint64)
    matrix = np.zeros((classlm.CLASSES, classlm.CLASSES))
    matrix[0, 1], matrix[0, 2], matrix[1, 0], matrix[1, 2], matrix[2, 0], matrix[2, 1] = 4, 4, 4, 2, 4, 2
    for before in range(6):
        each = [10 ** classlm.token_scores(np.array([before, w]), np.array([2]), klass, total, 2, matrix, 20, 5)[1][1] for w in range(6)]
        assert sum(each) == pytest.approx(1, abs=1e-9)


def test_buckets_grow_slower_than_chunks():
    assert classlm._bucket_count(10**6, 160) < 60 and classlm._bucket_count(10**7, 9_400) * 9_400 < 2_500_000


def test_edges(spark):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "A b\tA b"), (3, "A b\tA b"), (4, "x " * 50_000), (6, "new words"), (8, "é É")]
    same(classlm.score(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int")).collect(), base(rows))
    assert classlm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
