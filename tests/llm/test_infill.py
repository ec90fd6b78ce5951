import hashlib
import random
import re

import numpy as np
import pytest

from sparkpanel.llm import infill, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text, seed=42, percent=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(tokens[:i]), "".join(tokens[i:j]), "".join(tokens[j:])
    return (n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < spm else (n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def texts():
    rng = random.Random(8)
    odd = [None, "", " ", "\n\n", "a", " a", "a ", "a<P>b", "<", "<<S", "S> <M", "ä ö ü x", "😀 😀😀\t😀", "\x00 \x1f\x85 y", "a\x0b\x0cb\r\n", "x" * 100_000, " " * 50_000 + "z", "w " * 60_000]
    return odd + ["".join(rng.choice("ab<PSM> \n\täß😀") for _ in range(rng.randrange(200))) for _ in range(400)]


def test_matches_regular_expression_and_round_trip(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts() * 2)] + [(None, "one two three", "x", 1)] * 3 + [(5, "a b", "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, __x int")
    got = infill.restore(infill.transform(df)).collect()
    want = sorted(((d, t, *plain(d, t)) for d, t, _, _ in rows), key=repr)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert all(r.restored == (r.text or "") and r["__x"] == 1 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    other = infill.transform(df, seed=7, percent=100, spm_percent=0).collect()
    assert sorted((repr(r.doc_id), r.output) for r in other) == sorted((repr(d), plain(d, t, 7, 100, 0)[4]) for d, t, _, _ in rows)
    assert infill.restore(infill.transform(df.filter("n = ''"))).collect() == []


@pytest.mark.parametrize("error", [3, 126])
def test_index_is_exact_and_its_segments_are_bounded(error):
    rng = np.random.default_rng(2)
    for offsets in (np.arange(1), np.arange(5000) * 7, np.cumsum(rng.integers(1, 30, 20_000)), np.cumsum(rng.choice([1, 5000], 3000)), np.cumsum(np.repeat([1, 40, 2], 3000)), np.array([0, 10**9])):
        offsets = offsets - offsets[0]
        index = infill.RankIndex.fit(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offset(ranks) == offsets).all() and index.residual.dtype == np.int8
        assert np.abs(offsets - index.predict(ranks)).max() <= error + 1
    assert len(infill.RankIndex.fit(np.arange(100_000) * 6).first) == 1
    assert len(infill.RankIndex.fit(np.cumsum(np.repeat([1, 40, 2], 3000))).first) <= 5


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, "/root/testdata/sf0.01").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in docs:
        n, form, a, b, output = plain(r.doc_id, r.text)
        assert tuple(got[r.doc_id])[1:] == (n, form, a, b, digest(output), digest(r.text or ""))
