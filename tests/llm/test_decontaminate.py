import random

from sparkpanel.llm import decontaminate as dc


def plain(text):
    return " ".join(text.lower().split(" "))


def semi_global(passage, text):
    """Fewest edits of passage to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def mutated(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_matches_brute_force_alignment(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(6, 20))) for i in range(12)]
    docs = []
    for i in range(150):
        text = prose(rng.randrange(0, 40))
        if i % 3:
            passage = items[i % 12][1]
            text += " " + mutated(rng, passage, rng.randrange(0, int(0.16 * len(passage)) + 1)) + " " + prose(rng.randrange(0, 30))
        docs.append((i, text.strip()))
    got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, p in items if semi_global(p, t) <= dc.edit_budget(len(p))}
    assert got == want and want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda s: " ".join(s.lower().split())
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if norm(b.text) in norm(d.text)}
    found = dc.leaks(docs, items).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found} and want
    texts, passages = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    for r in found:
        if not r.edits:
            assert norm(texts[r.doc_id][r.start : r.end]) == norm(passages[r.item_id])


def test_edges_and_passes(spark, monkeypatch):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "short"), (5, "İstanbul is a large city on two continents")], "item_id long, text string")
    rows = [(1, None, "a"), (2, "", "a"), (3, "so THE QUICK\n brown fox jumps over the lazy dog. " * 2, "a"), (4, "İİ İstanbul is a large city on two continents", "b"), (None, "nothing here", "c"), (None, "nothing here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    for limit in (dc.PASS_CHARS, 30):
        monkeypatch.setattr(dc, "PASS_CHARS", limit)
        got = sorted((r.doc_id, r.item_id, r.edits) for r in dc.leaks(docs, items).collect())
        assert got == [(3, 1, 0), (3, 1, 0), (4, 5, 0)]
        assert sorted(dc.clean(docs, items).collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id not in (3, 4)], key=str)
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).count() == 0


def test_banded_alignment_finds_what_the_whole_table_finds():
    rng, found = random.Random(8), 0
    for _ in range(400):
        passage = mutated(rng, "".join(rng.choice("abcde ") for _ in range(rng.randrange(20, 70))).strip(), 0)
        text = "".join(rng.choice("abcde ") for _ in range(rng.randrange(60))) + mutated(rng, passage, rng.randrange(9)) + "".join(rng.choice("abcde ") for _ in range(rng.randrange(60)))
        index = dc.Index.build([(1, passage)])
        if not index.ids:
            continue
        p, t = ("".join(map(chr, x)) for x in (index.passages[0], dc.normalised(text)[0]))
        best = semi_global(p, t)
        got = min((x["edits"] for x in dc.leaks_of(index, [text])[0]), default=None)
        assert got == (best if best <= index.budget[0] else None)
        found += got is not None
    assert found > 100


def test_passes_one_by_one_answer_as_one(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "PASS_CHARS", benchmark.selectExpr("sum(length(text))").first()[0] // 3)
    assert sorted(map(tuple, dc.leaks(docs, benchmark).collect())) == want
    long = spark.createDataFrame([(1, "filler words " * 60_000 + benchmark.first().text + " and more" * 1000), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id for r in dc.leaks(long, benchmark).collect()} == {1} and dc.clean(long, benchmark).count() == 2
