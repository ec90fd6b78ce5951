"""Streams whose state lives between batches, against their batch twins after every batch."""

import math

import pytest
from pyspark.sql import functions as F

from sparkpanel.plans import fixtures
from sparkpanel.streaming import keyed, live

DATA = "/root/testdata/sf0.001"


def targets(spark, folder):
    number = max(int(p.name) for p in (folder / "targets").iterdir() if p.name.isdigit())
    return {r.name: (r.date, r.signal, r.target) for r in spark.read.parquet(f"{folder}/targets/{number}").collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for name, (date, signal, target) in want.items():
        assert got[name][0] == date and got[name][2] == target and math.isclose(got[name][1], signal, rel_tol=1e-9, abs_tol=1e-9), name


def test_scheduled_signals_equal_the_batch_twin_after_each_batch(spark, tmp_path):
    panel = fixtures.stock_panel(spark, DATA).select("name", "date", "ret", "mkt").persist()
    rows = sorted(panel.collect(), key=lambda r: (r.date, r.name))
    # five deliveries; every seventh bar comes one delivery late, and one entity stops early
    parts = [[] for _ in range(6)]
    for i, r in enumerate(rows):
        k = i * 5 // len(rows)
        if r.name % 5 != 1 or k < 2:
            parts[k + (i % 7 == 0)].append(r)
    so_far = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, panel.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        so_far += part
        stream = spark.readStream.schema(panel.schema).parquet(f"{tmp_path}/in/*")
        keyed.run_scheduled(stream, "ret", "mkt", 3, 300.0, f"{tmp_path}/job", late="2000 days", idle="9000 days")
        twin = live.scheduled_signal(spark.createDataFrame(so_far, panel.schema), "ret", "mkt", 3, 300.0)
        same(targets(spark, tmp_path / "job"), {r.name: (r.date, r.signal, r.target) for r in twin.collect()})
    assert len(targets(spark, tmp_path / "job")) == len({r.name for r in rows})
    panel.unpersist()


def test_idle_entities_lose_their_state_and_late_bars_are_dropped(spark, tmp_path):
    schema = "name string, date timestamp, ret double, mkt double"
    deliveries = [
        [("a", "2024-01-01", 0.1, 0.1), ("b", "2024-01-01", -0.1, -0.1), (None, "2024-01-01", 0.0, 0.0)],
        [("b", "2024-01-20", None, 0.2), ("b", "2024-01-10", 0.2, None)],
        [("b", "2024-01-21", 0.3, 0.1), ("b", "2024-01-02", 9.9, 9.9)],
    ]
    for k, rows in enumerate(deliveries):
        df = spark.createDataFrame(rows, "name string, date string, ret double, mkt double").withColumn("date", F.col("date").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        keyed.run_scheduled(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "ret", "mkt", 1, 100.0, f"{tmp_path}/job", late="2 days", idle="5 days")
    latest = keyed.latest_signals(spark, f"{tmp_path}/job").collect()
    assert [(r.name, str(r.date)[:10]) for r in latest] == [("b", "2024-01-21")]
    assert latest[0].signal == pytest.approx(keyed.signal_of([-0.1, 0.2, None, 0.3], [-0.1, None, 0.2, 0.1]))


def test_signal_needs_no_more_than_the_kept_bars(spark):
    look = keyed.Lookbacks()
    rows = [math.sin(i * 1.7) for i in range(60)]
    market = [math.cos(i) for i in range(60)]
    for n in range(1, 60):
        assert keyed.signal_of(rows[:n], market[:n]) == pytest.approx(keyed.signal_of(rows[:n][-look.rows :], market[:n][-look.rows :]), abs=1e-12)


def test_live_top_equals_its_batch_twin(spark, tmp_path):
    trades = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    quotes, cut = live.daily_quotes(trades), F.lit("2024-01-20").cast("timestamp")
    history = quotes.filter(F.col("date") < cut).groupBy("name").agg(F.avg("v_today").alias("average"))
    trades.filter(F.col("ts") >= cut).coalesce(1).write.parquet(f"{tmp_path}/in")
    live.run_live_top(spark.readStream.schema(trades.schema).parquet(f"{tmp_path}/in"), history, 50.0, 5.0, 8, f"{tmp_path}/job", "60 days")
    got = spark.read.parquet(f"{tmp_path}/job/top/0").collect()
    want = live.top(live.live_volume_ratio(quotes.filter(F.col("date") >= cut), history, 50.0, 5.0), "v_ratio", 8).collect()
    assert len(got) == 8 and {(r.name, r.date, round(r.v_ratio, 9)) for r in got} == {(r.name, r.date, round(r.v_ratio, 9)) for r in want}
    assert live.live_volume_ratio(quotes, history, 50.0, 0.0).count() < live.live_volume_ratio(quotes, history, 50.0, 5.0).count()
