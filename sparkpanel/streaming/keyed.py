"""Scheduled signals over a stream of bars: what an entity needs of its past is kept as state between batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.checkpoints import drop_table
from ..panel import Axis
from .live import latest_targets

AX = Axis()


@dataclass(frozen=True)
class Lookbacks:
    """Rows of the z-scores, of the comovement and of its average."""

    score: int = 12
    comovement: int = 6
    average: int = 3

    @property
    def rows(self) -> int:
        """Bars of an entity that its latest signal depends on."""
        return self.score + self.comovement + self.average - 2


def zscore(values: Sequence[float | None]) -> float | None:
    """The last value less the mean of all, over their sample deviation; null without two values or any spread.

    Sums go in the order of the rows, as a window's do.
    """
    if values[-1] is None:
        return None
    n, mean, squares, total = 0, 0.0, 0.0, 0.0
    for x in values:
        if x is not None:
            n += 1
            step = x - mean
            mean += step / n
            squares += step * (step - step / n)
            total += x
    if n < 2 or not squares:
        return None
    return (values[-1] - total / n) / math.sqrt(squares / (n - 1))


def signal_of(r: Sequence[float | None], market: Sequence[float | None], look: Lookbacks = Lookbacks()) -> float:
    """Signal at the last of an entity's bars: z-score of its return plus that of its averaged down-comovement."""
    down = [1.0 if x is not None and y is not None and x < 0 and y < 0 else 0.0 for x, y in zip(r, market, strict=True)]
    mean = lambda of, i, n: sum(of[max(0, i - n + 1) : i + 1]) / min(i + 1, n)
    shares = [mean(down, i, look.comovement) for i in range(len(down))]
    averages = [mean(shares, i, look.average) for i in range(len(shares))]
    return (zscore(r[-look.score :]) or 0.0) + (zscore(averages[-look.score :]) or 0.0)


def keyed_signals(bars: DataFrame, r: str, market: str, late: str = "1 day", idle: str = "30 days", look: Lookbacks = Lookbacks(), ax: Axis = AX) -> DataFrame:
    """Stream of (name, time, signal, gone): an entity's signal after each batch that brings bars of it.

    The state of an entity is its last ``look.rows`` bars in the order of their
    time, so it is bounded, and a late bar takes its place among them; bars later than
    ``late`` behind the newest bar of earlier batches are dropped. An entity without a bar for
    ``idle`` after its last one (by the stream's watermark) loses its state, and one row says
    so by ``gone``. Null returns count as missing; bars without a name or time are left out.
    """
    keep, wait = look.rows, int(pd.Timedelta(idle).total_seconds() * 1000)
    name, time = ax.name, ax.time

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({name: [key[0]], time: [pd.NaT], "signal": [None], "gone": [True]})
            return
        at, x, y = (list(c) for c in state.get) if state.exists else ([], [], [])
        for batch in batches:
            at += (batch[time].astype("datetime64[us]").astype("int64")).tolist()
            x += batch[r].astype(object).where(batch[r].notna(), None).tolist()
            y += batch[market].astype(object).where(batch[market].notna(), None).tolist()
        order = sorted(range(len(at)), key=at.__getitem__)[-keep:]
        at, x, y = ([c[i] for i in order] for c in (at, x, y))
        state.update((at, x, y))
        state.setTimeoutTimestamp(max(at[-1] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({name: [key[0]], time: pd.to_datetime([at[-1]], unit="us"), "signal": [signal_of(x, y, look)], "gone": [False]})

    kind = bars.schema[name].dataType.simpleString()
    known = bars.select(name, time, F.col(r).cast("double").alias(r), F.col(market).cast("double").alias(market)).filter(F.col(name).isNotNull() & F.col(time).isNotNull())
    return known.withWatermark(time, late).groupBy(name).applyInPandasWithState(
        follow, f"{name} {kind}, {time} timestamp, signal double, gone boolean", "at array<long>, r array<double>, market array<double>", "update", GroupStateTimeout.EventTimeTimeout
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables in a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []


def latest_signals(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that run_scheduled() keeps: one row for each entity that has state. None before the first batch."""
    done = _versions(spark, f"{folder}/latest")
    return spark.read.parquet(f"{folder}/latest/{done[-1]}") if done else None


def run_scheduled(bars: DataFrame, r: str, market: str, n: int, money: float, folder: str, late: str = "1 day", idle: str = "30 days", look: Lookbacks = Lookbacks(), ax: Axis = AX) -> None:
    """Take in all bars there are, batch by batch, and stop; the next call goes on from there.

    ``folder`` (shared) has the stream's checkpoint, ``latest/<batch>``, the newest signal of
    every entity, and ``targets/<batch>``, the targets of the whole cross-section after
    that batch. A batch that runs again after a failure writes the same tables again.
    """
    spark = bars.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        done = [v for v in _versions(spark, f"{folder}/latest") if v < number]
        new = batch.persist()
        try:
            now = new.filter("not gone").drop("gone")
            if done:
                before = spark.read.parquet(f"{folder}/latest/{done[-1]}")
                now = before.join(new.select(ax.name), ax.name, "left_anti").unionByName(now)
            now.write.mode("overwrite").parquet(f"{folder}/latest/{number}")
        finally:
            new.unpersist()
        latest = spark.read.parquet(f"{folder}/latest/{number}")
        latest_targets(latest, n, money, ax).write.mode("overwrite").parquet(f"{folder}/targets/{number}")
        for old in done[:-1]:
            drop_table(spark, f"{folder}/latest/{old}")

    query = keyed_signals(bars, r, market, late, idle, look, ax).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
