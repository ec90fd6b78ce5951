import numpy as np
from pyspark.sql import functions as F

from sparkpanel.llm import common


def test_bitmap_never_misses_a_key(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k long")
    bitmap = common.key_bitmap(df)
    assert bitmap.may_hold(keys).all() and bitmap.may_hold(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.1
    assert common.key_bitmap(df, most=1 << 10) is None and not common.key_bitmap(df.limit(0)).may_hold(keys).any()


def test_rows_without_ids_by_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 2, 3)] + [(None, "none"), (-5, None)], "doc_id int, text string")
    gone = spark.createDataFrame([(2,), (-5,), (77,)], "id long")
    want = [(1, "t1"), (3, "t3"), (None, "none")]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, common.without_ids(docs, gone).collect()), key=key) == want
    assert common.without_ids(docs, gone.limit(0)).count() == 6 and common.without_ids(docs.limit(0), gone).count() == 0
    monkeypatch.setattr(common, "key_bitmap", lambda keys: None)
    assert sorted(map(tuple, common.without_ids(docs, gone).collect()), key=key) == want


def test_samples_by_smallest_hash(spark):
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") < 50, "small").otherwise("large"))
    every = [r.id for r in df.orderBy(F.xxhash64("id")).limit(300).collect()]
    assert sorted(r.id for r in common.smallest_hashes(df, ["id"], 300).collect()) == sorted(every)
    sizes = {r.g: r["count"] for r in common.smallest_hashes(df, ["id"], 100, ["g"]).groupBy("g").count().collect()}
    assert sizes == {"small": 50, "large": 100} and common.smallest_hashes(df.limit(0), ["id"], 5).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    common.bounded_batches(spark)
    df = spark.createDataFrame([("x" * 3_000_000,)] * 9, "text string").coalesce(1)
    sizes = df.mapInArrow(lambda batches: (b.select([]).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 9 and max(r.n for r in sizes) <= 4


def test_join_of_hot_keys_is_the_plain_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i % 40, i) for i in range(600)] + [(None, 7)] * 3, "k int, v int")
    keys = rows.filter("k < 30").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("w"))
    want = sorted(map(tuple, rows.join(keys, "k").select("k", "v", "n", "w").collect()))
    for most in (1, 5, 1000):
        assert sorted(map(tuple, common.join_seen(rows, keys, ["k"], "n", most).select("k", "v", "n", "w").collect())) == want
    assert common.join_seen(rows, keys.filter("k < 0"), ["k"], "n").count() == 0
