"""Option-chain aggregation and contract selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, ratio

AX = Axis()


def aggregate(df: DataFrame, signals: list[str], weight: str | None = None, flag: str = "cp_flag", extra: list[str] | None = None, ax: Axis = AX) -> DataFrame:
    """Weighted means of calls, puts and all, their ratio and spreads, for several signals in one aggregation.

    Only cells that hold both calls and puts are kept. Rows with a null signal
    still count in the denominator.
    """
    w = F.abs(F.col(weight)) if weight else F.lit(1.0)
    call, put = F.col(flag) == "C", F.col(flag) == "P"
    sums = [F.sum(F.when(call, 1)).alias("__c"), F.sum(F.when(put, 1)).alias("__p"), F.sum(F.when(call, w)).alias("__wc"), F.sum(F.when(put, w)).alias("__wp"), F.sum(w).alias("__w")]
    for s in signals:
        x = F.col(s) * w
        sums += [F.sum(F.when(call, x)).alias(f"__{s}_c"), F.sum(F.when(put, x)).alias(f"__{s}_p")]
    both = df.groupBy(ax.time, ax.name, *(extra or [])).agg(*sums).filter("__c > 0 and __p > 0")
    out = []
    for s in signals:
        c, p = ratio(f"__{s}_c", "__wc"), ratio(f"__{s}_p", "__wp")
        zero = F.lit(0.0)
        out += [
            c.alias(f"{s}_C"), p.alias(f"{s}_P"), ratio(F.coalesce(f"__{s}_c", zero) + F.coalesce(f"__{s}_p", zero), F.col("__w")).alias(f"{s}_avg"), ratio(c, p).alias(f"{s}_ratio"),
            (c - p).alias(f"{s}_spread1"), ratio(F.coalesce(f"__{s}_c", zero) - F.coalesce(f"__{s}_p", zero), F.col("__w")).alias(f"{s}_spread2"),
        ]
    return both.select(ax.time, ax.name, *(extra or []), *out)


def skew(df: DataFrame, iv: str, moneyness: str, weight: str | None = None, ax: Axis = AX) -> DataFrame:
    """Low-moneyness less high-moneyness implied volatility: C-C, C-P, P-P, P-C and of the averages."""
    side = df.withColumn("__side", F.when(F.col(moneyness) <= 1, "low").when(F.col(moneyness) > 1, "high")).filter("__side is not null")
    cells = aggregate(side, [iv], weight, extra=["__side"], ax=ax)
    pick = lambda s, c: F.max(F.when(F.col("__side") == s, F.col(f"{iv}_{c}")))
    parts = [pick(s, c).alias(f"{s}_{c}") for s in ("low", "high") for c in ("C", "P", "avg")]
    wide = cells.groupBy(ax.time, ax.name).agg(*parts)
    return wide.select(ax.time, ax.name, *[(F.col(f"low_{a}") - F.col(f"high_{b}")).alias(f"skew_{a}_{b}") for a, b in (("C", "C"), ("C", "P"), ("P", "P"), ("P", "C"), ("avg", "avg"))])


def select_by_max(df: DataFrame, first: str, second: str, keys: list[str], contract: str = "id") -> DataFrame:
    """One contract per key: largest first, then largest second, then smallest id."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(first), F.desc_nulls_last(second), contract)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def select_option(df: DataFrame, volume: str, strike: str, days: str, keys: list[str]) -> DataFrame:
    """Contracts of the largest volume, then strike, then days to expiry; ties stay, null keys go."""
    w = Window.partitionBy(*keys).orderBy(F.desc(volume), F.desc(strike), F.desc(days))
    full = df.filter(F.col(volume).isNotNull() & F.col(strike).isNotNull() & F.col(days).isNotNull())
    return full.withColumn("__n", F.rank().over(w)).filter("__n = 1").drop("__n")


def _nearest(df: DataFrame, days: str, least_days: int, keys: list[str]) -> DataFrame:
    ok = df.filter(F.col(days) >= least_days)
    return ok.withColumn("__d", F.min(days).over(Window.partitionBy(*keys))).filter(F.col(days) == F.col("__d")).drop("__d")


def select_calls(df: DataFrame, price: str, strike: str, days: str, least_days: int, out_by: float, keys: list[str], contract: str = "id") -> DataFrame:
    """Of the nearest expiry not before least_days, the lowest strike at or above price * (1 + out_by)."""
    ok = _nearest(df, days, least_days, keys).filter(F.col(strike) >= F.col(price) * (1 + out_by))
    w = Window.partitionBy(*keys).orderBy(F.asc(strike), contract)
    return ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def select_puts(df: DataFrame, price: str, strike: str, days: str, least_days: int, out_by: float, keys: list[str], contract: str = "id") -> DataFrame:
    """Of the nearest expiry not before least_days, the highest strike at or below price * (1 - out_by)."""
    ok = _nearest(df, days, least_days, keys).filter(F.col(strike) <= F.col(price) * (1 - out_by))
    w = Window.partitionBy(*keys).orderBy(F.desc(strike), contract)
    return ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fixed_contracts(selected: DataFrame, chain: DataFrame, cycle: str, contract: str = "id", ax: Axis = AX) -> DataFrame:
    """The first selected contract of each expiry cycle, with its whole series from the chain."""
    w = Window.partitionBy(ax.name, cycle).orderBy(ax.time, contract)
    first = selected.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(ax.name, cycle, contract)
    return chain.join(first, [ax.name, cycle, contract])


def elasticity_pick(df: DataFrame, elasticity: Column, cut: float, keys: list[str], contract: str = "id") -> DataFrame:
    """Per key the smallest elasticity of at least cut."""
    ok = df.withColumn("elasticity", elasticity).filter(F.col("elasticity") >= cut)
    w = Window.partitionBy(*keys).orderBy("elasticity", contract)
    return ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
