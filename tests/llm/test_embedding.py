import numpy as np

from sparkpanel.llm import embedding, queries


def brute(rows):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if v and None not in v and l is not None and np.isfinite(np.array(v, float)).all() and any(v)]
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, v, l in ok:
        by.setdefault((l, len(v)), []).append((i, v))
    for group in by.values():
        ids, x = [i for i, _ in group], np.array([v for _, v in group])
        n = np.linalg.norm(x, axis=1)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T / np.outer(n, n) >= 0.98, 1)), strict=True):
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = sorted((find(ids[a]), find(ids[b])))
            parent[q] = p
    return sorted((i, links[i], find(i)) for i in links)


def test_contract_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op7_embedding(spark, "/root/testdata/sf0.1").collect())
    assert got == brute(rows)


def test_edges_and_chains(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, at = [], rng.normal(size=12)
    for i in range(300):  # a chain of near vectors, copies, scaled copies and noise
        at = at + rng.normal(size=12) * (0.06 if i % 7 else 2)
        rows.append((i, at.tolist(), i % 2))
    rows += [(400 + i, rows[0][1], 0) for i in range(50)] + [(500, [2 * x for x in rows[0][1]], 0), (501, rows[0][1], 1), (502, rows[0][1], None)]
    rows += [(600, None, 0), (601, [0.0] * 12, 0), (602, [float("nan")] * 12, 0), (603, [None] + [1.0] * 11, 0), (604, [1.0], 0), (605, [3.0], 0), (606, [], 0), (607, [float("inf")] * 12, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, dim string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect())
    assert got == brute(rows)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    doubled = embedding.near_duplicates(df.filter("vec_id = 600").union(df.filter("vec_id = 600"))).collect()
    assert [tuple(r) for r in doubled] == [(600, 0, 600, True)] * 2


def test_ties_at_the_threshold(spark):
    """Cosines of exactly 0.98 and next to it, as double precision has them."""
    rows = [(0, [1.0, 0.0], 0)]
    for i, c in enumerate((0.98, np.nextafter(0.98, 0), np.nextafter(0.98, 1), 0.9799999, 0.9800001), 1):
        rows.append((i, [float(c), float(np.sqrt(1 - c * c))], 0))
    rows += [(20, [49.0, float(np.sqrt(99))], 0), (21, [98.0, 19.8997487421324], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()) == brute(rows)
