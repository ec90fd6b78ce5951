import hashlib
from collections import Counter

import pytest

from sparkpanel.llm import queries, substring


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept.decode()))
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_contract_matches_brute_force(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").collect()
    want = sorted((r.doc_id, n, g, hashlib.sha256(t.encode()).hexdigest()) for r, (n, g, t) in zip(docs, brute([r.text for r in docs], 35), strict=True))
    got = sorted(tuple(r) for r in queries.op2_substring(spark, f"/root/testdata/{scale}").collect())
    assert got == want and any(g for _, _, g, _ in want)


def test_edges(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(9))
    texts = [None, "", "  \t", b, b, f"{a} {b} {a}", f"x {a[3:]}", "z " * 100, f"{b} {b}\n{b}", "q " * 34, "é " * 40 + b, "long " * 30_000]
    for width in (5, 35):
        rows = [(i if i % 4 else None, t, i) for i, t in enumerate(texts)]
        got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, tk int"), width).collect()
        assert sorted((r.n_words, r.n_removed, r.text) for r in got) == sorted(brute(texts, width))
        for r in got:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
