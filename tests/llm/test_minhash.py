import itertools

from sparkpanel.llm import minhash


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(minhash.near_duplicates(docs)) == want


def test_chains_copies_and_edges(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(base[:55] + ["x"] * 3)), (13, " ".join(base[:50] + ["x"] * 3 + ["y"] * 3)),
            (1, None), (2, ""), (3, " \t\n "), (4, "two words"), (5, "TWO  words"), (6, "two"), (7, "a b c d e"), (8, "é É"), (9, "É É")]
    rows += [(100 + i, " ".join(base[: 58 - i % 5] + [f"z{i}"])) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, digest string, bucket long")
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_empty_null_id_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")], schema)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 5, False)]


def hard_rows():
    """Exact ties at 75 %, just under it, a very long text with its copy, and many texts that share one passage."""
    w = [f"v{i}" for i in range(40)]
    rows = [(1, " ".join(w[:11])), (2, " ".join([*w[:10], "x"])), (3, " ".join(w[:16])), (4, " ".join([*w[:14], "y", "z"]))]  # 6 of 8, 10 of 14 shingles in common
    long = " ".join(f"w{i % 997}x{i % 1009}" for i in range(60_000))
    rows += [(10, long), (11, long + " one more"), (12, long[:300_000])]
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(100 + i, f"{common} " + " ".join(f"u{i}_{j}" for j in range(20 + i % 9))) for i in range(30)]
    return rows + [(200 + i, " ".join(f"n{j if j % 30 else j + i % 4}" for j in range(120))) for i in range(25)]


def test_ties_long_texts_and_both_routes(spark, monkeypatch):
    """Buckets and prefixes answer alike, and as brute force does."""
    rows = hard_rows()
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert want[2][1] == 1 and want[4][1] == 4 and want[11][1] == 10
    for crowd in (0, 8, 10**9):
        monkeypatch.setattr(minhash, "CROWD", crowd)
        assert result(minhash.near_duplicates(docs)) == want
    monkeypatch.setattr(minhash, "key_bitmap", lambda ids: None)
    assert result(minhash.near_duplicates(docs)) == want


def test_texts_of_one_id_are_answered_each(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (7, "other words of no one else")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 7), (9, 5)]
