"""The pipeline against a plain version of its stages on the smallest documents."""

import itertools
import re

from tokenizers import Tokenizer

import corpus_pipeline
from sparkpanel.llm import pii
from sparkpanel.llm.queries import TOKENIZER

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each_group(docs):
    sets, parent = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def test_stages_and_result(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    lettered = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    single = one_of_each_group(lettered)
    clean = {i: t for i, t in single.items() if not any(p in " ".join(t.lower().split()) for p in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == set(clean)  # these tables hold no inexact benchmark passages
    library = Tokenizer.from_file(TOKENIZER)
    for i, r in got.items():
        if not pii.base_spans(clean[i]):
            assert r.ids == library.encode(clean[i], add_special_tokens=False).ids
    assert all(len(r.ids) == r.n_tokens for r in got.values())


def test_stages_keep_columns_and_take_hard_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "12 34", "en", "a", 5), (4, "mail me at a.b@example.org please my friend", "en", "a", 0), (4, "mail me at a.b@example.org please my friend", "en", "a", 0),
            (5, "word " * 20_000, None, "b", 1), (None, "quite another text of some words", "en", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, DATA)
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, DATA).count() == table.count()
