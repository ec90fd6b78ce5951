"""Live jobs: the same functions score a batch and each micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import average_absolute
from ..operators.ranking import last_row
from ..operators.rolling import comovement, rolling_mean, rolling_zscore
from ..panel import Axis, ratio

AX = Axis()


def daily_volume(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Volume per entity and day; on a stream, late events are waited for as long as the watermark says."""
    events = events.withWatermark("ts", watermark) if events.isStreaming else events
    return events.groupBy(F.window("ts", "1 day").alias("w"), "name").agg(F.sum("value").alias("volume")).select("name", F.col("w.start").alias("date"), "volume")


def daily_quotes(trades: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Per entity and day of trades (name, ts, price, volume): volume, dollar volume, and the mean absolute return of high, low and last price since the first."""
    trades = trades.withWatermark("ts", watermark) if trades.isStreaming else trades
    first, last = F.min_by("price", "ts"), F.max_by("price", "ts")
    day = trades.groupBy(F.window("ts", "1 day").alias("w"), "name").agg(F.sum("volume").alias("v_today"), first.alias("__f"), last.alias("last_price"), F.max("price").alias("__h"), F.min("price").alias("__l"))
    move = average_absolute(*(ratio(c, "__f") - 1 for c in ("__h", "__l", "last_price")))
    return day.select("name", F.col("w.start").alias("date"), "v_today", "last_price", (F.col("v_today") * F.col("last_price")).alias("v_d_today"), move.alias("r_avg"))


def live_volume_ratio(quotes: DataFrame, history: DataFrame, least_value: float, most_return: float) -> DataFrame:
    """Quotes (of ``daily_quotes``) with today's volume over the entity's historical mean (name, average).

    Kept are quotes of a dollar volume of ``least_value`` at least that moved by
    ``most_return`` on average at most; entities without a history or a return are left out.
    """
    met = quotes.join(history, "name").filter((F.col("v_d_today") >= least_value) & (F.abs("r_avg") <= most_return))
    return met.withColumn("v_ratio", ratio("v_today", "average"))


def run_live_top(trades: DataFrame, history: DataFrame, least_value: float, most_return: float, n: int, folder: str, watermark: str = "1 day") -> None:
    """Take in all trades there are and write ``folder/top/<batch>``, the n largest volume ratios among the days that a batch brought up to date."""

    def each(batch: DataFrame, number: int) -> None:
        top(live_volume_ratio(batch, history, least_value, most_return), "v_ratio", n).write.mode("overwrite").parquet(f"{folder}/top/{number}")

    run_available(daily_quotes(trades, watermark), each, f"{folder}/checkpoint")


def volume_ratio(today: DataFrame, history: DataFrame, least: float) -> DataFrame:
    """Today's volume over the entity's historical mean (static side), where it is at least ``least``."""
    return today.join(history, "name").withColumn("v_ratio", ratio("volume", "average")).filter(F.col("v_ratio") >= least)


def top(scored: DataFrame, signal: str, n: int) -> DataFrame:
    """The n rows of the largest signal, ties by name and date."""
    return scored.orderBy(F.desc(signal), "name", "date").limit(n)


def latest_targets(latest: DataFrame, n: int, money: float, ax: Axis = AX) -> DataFrame:
    """Targets of one cross-section (each entity's latest ``signal``): the n lowest sell, the n highest buy, equal shares of money."""
    keyed = latest.withColumn("__s", F.round("signal", 9)).filter("signal is not null")
    low = keyed.orderBy("__s", ax.name).limit(n).select(ax.name, F.lit(-money / n).alias("__low"))
    high = keyed.orderBy(F.desc("__s"), F.desc(ax.name)).limit(n).select(ax.name, F.lit(money / n).alias("__high"))
    met = latest.join(F.broadcast(low), ax.name, "left").join(F.broadcast(high), ax.name, "left")  # n rows each
    return met.select(ax.name, ax.time, "signal", F.coalesce("__low", "__high", F.lit(0.0)).alias("target"))


def scheduled_signal(bars: DataFrame, r: str, market: str, n: int, money: float, ax: Axis = AX) -> DataFrame:
    """Targets from the latest return's z-score and that of averaged down-comovement, from all bars at once.

    ``keyed.run_scheduled`` gives the same after each batch of a stream.
    """
    df = bars.withColumn("__z", rolling_zscore(r, -11, 0, ax)).withColumn("__c", comovement(r, market, -5, 0, "down", ax))
    df = df.withColumn("__c", rolling_mean("__c", -2, 0, ax)).withColumn("__cz", rolling_zscore("__c", -11, 0, ax))
    latest = last_row(df.withColumn("signal", F.coalesce("__z", F.lit(0.0)) + F.coalesce("__cz", F.lit(0.0))), ax)
    # one cross-section: all entities at their latest bar; only its n lowest and n highest have a target
    return latest_targets(latest, n, money, ax)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process all that is there, one call per micro-batch, and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
