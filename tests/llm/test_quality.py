import zlib

import numpy as np

from sparkpanel.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    held = {i for i in known if zlib.crc32(str(i).encode()) % 5 == 0}
    fitted = quality.train(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"))
    got = {r.doc_id: r for r in quality.classify(docs, labels, model=fitted).collect()}
    assert len(got) == docs.count()
    right = sum((got[i].quality >= 0.5) == bool(known[i].quality) for i in held) / len(held)
    toxic = [i for i in held if known[i].toxic]
    found = sum(got[i].toxic > 0.5 for i in toxic) / len(toxic)
    wrong = sum(got[i].toxic > 0.5 for i in held if not known[i].toxic) / (len(held) - len(toxic))
    print(right, found, wrong)
    assert right > 0.95 and found > 0.75 and wrong < 0.01  # a fifth of the toxic rows hold no word that tells


def test_sparse_sites_shrink(spark):
    rows = [(i, "good words here", "big", "en") for i in range(300)] + [(400 + i, "bad junk ###", "bad", "en") for i in range(300)] + [(800, "bad junk ###", "one", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows if i < 800], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[0].host_quality > 0.9 and got[400].host_quality < 0.1
    assert 0.1 < got[800].path_quality < 0.6  # one document says little about its site
    assert got[0].kept and not got[400].kept


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, host int"
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "a", "b", 1), (1, "", "a", "b", 1), (2, "x " * 30_000, None, "b", 1)], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        assert quality.classify(docs, l).count() == 4
    assert all(r.kept and r.quality == 0.5 for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_prior_strength_leaves_out_sampling_variance():
    """Sites of one and the same quality: their spread is chance, and the prior is as strong as it may be."""
    rng = np.random.default_rng(4)
    sizes, mean = np.array([2] * 300), 0.3
    docs = [rng.random(n) < mean for n in sizes]
    m, n = np.mean(np.concatenate(docs)), sizes.sum()
    spread = sum(k * (d.mean() - m) ** 2 for k, d in zip(sizes, docs, strict=True)) / n
    within = sum(((d - d.mean()) ** 2).sum() for d in docs)
    assert quality.strength(m, spread, within, 300, 1, n) > 20 > quality.strength(m, spread, 0.0, 300, 1, n)
    different = [np.full(n, i % 2) * 0.8 + 0.1 for i, n in enumerate(sizes)]
    spread = sum(k * (d.mean() - 0.5) ** 2 for k, d in zip(sizes, different, strict=True)) / n
    assert quality.strength(0.5, spread, 0.0, 300, 1, n) == 2.0
