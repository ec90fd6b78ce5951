import zlib

from pyspark.sql import functions as F

from sparkpanel.llm import langid, queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = spark.createDataFrame([(i, t * 20, l, "x") for i, (t, l) in enumerate([("hello world the ", "en"), ("der die und ", "de")] * 20)] + [(99, None, "en", ""), (98, "x", None, "")], schema)
    net = langid.train(train)
    rows = [(1, None, None, ""), (2, "", None, ""), (3, "123 !!", None, ""), (4, "the world hello", None, ""), (5, "und die der " * 9000, None, ""), (5, "und die der " * 9000, None, "")]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(spark.createDataFrame(rows, schema), net).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    nothing = langid.train(train.limit(0))
    assert langid.predict(train.limit(0), nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(train, nothing).collect()} == {"und"}
    assert langid.predict(train, net).filter(F.col("score") > 1).count() == 0
