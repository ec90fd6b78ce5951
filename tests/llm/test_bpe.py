import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkpanel.llm import bpe, queries

ODD = ["", None, "aaaaaaaaaaaaa aaaa", "<|endoftext|>", "x<|endoftext|><|startoftext|>!", "<|ENDOFTEXT|> a", "it's we're I'LL '''s", "ΑΣ ΣΑΣ Σ", "é é",
       "\x1c\x1d a\x85b\xa0c　d​q", "12 ½ ² ٣", "\0\0! \0<|endoftext|>", "日本語 テキスト 😀😀😀", "-" * 500, "ab" * 3000, "ab" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def test_contract_matches_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_bpe(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for i, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_odd_texts(spark, library):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(ODD)], "doc_id long, text string, ids array<int>")
    path = public_tokenizers.path("word_bpe_49k.json")
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (want, library.decode(want, skip_special_tokens=False))
    assert bpe.encode(df.limit(0), path).count() == 0


def test_store_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_PIECES", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.load(queries.TOKENIZER))
    for _ in range(3):
        for text in ("one two three", "four <|endoftext|> five six seven", "one"):
            ids, _ = encoder.encode([text])
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_by_both_ways(library, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "aé日😀") for n in (1001, 4000)] + ["a" * 5000, "short " + "xy" * 700 + " words"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (10, 1000, 10**9):
        monkeypatch.setattr(bpe, "LONG_PIECE", limit)
        ids, counts = bpe.Encoder(bpe.Vocabulary.load(queries.TOKENIZER)).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_one_long_piece_takes_linear_time():
    rng, encoder = random.Random(3), bpe.Encoder(bpe.Vocabulary.load(queries.TOKENIZER))
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    start = time.perf_counter()
    encoder.encode([text])
    assert time.perf_counter() - start < 10
