"""Order statistics of moving windows: one pass over each entity's sorted rows with a sorted window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..panel import Axis

AX = Axis()


class SortedWindow:
    """The last n values in order of arrival and of size; missing values take a place but have no size."""

    def __init__(self, n: int):
        self.n, self.arrived, self.ordered = n, deque(), []

    def push(self, value: float | None) -> None:
        if len(self.arrived) == self.n:
            old = self.arrived.popleft()
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]
        self.arrived.append(value)
        if value is not None:
            insort(self.ordered, value)

    def not_above(self, value: float) -> int:
        return bisect_right(self.ordered, value)

    def quantile(self, share: float) -> float | None:
        """Interpolated between the neighbours of the share's place."""
        if not self.ordered:
            return None
        at = (len(self.ordered) - 1) * share
        low = int(at)
        return self.ordered[low] if at == low else self.ordered[low] + (at - low) * (self.ordered[low + 1] - self.ordered[low])


def rolling_order(df: DataFrame, keys: list[str], order: str, value: str, n: int, shares: tuple[float, ...] = ()) -> DataFrame:
    """df with order statistics of ``value`` over the last n rows of its key: ``seen`` values, how many are ``not_above`` the present one, ``quantiles`` for the shares.

    Rows are dealt by key and sorted by Spark; a task reads them once, in order, and holds one window. A row costs the
    time to find a place in a sorted window, whatever n is. Null and NaN count as missing: such rows have null in
    ``not_above``. Rows of the same key and order may take each other's places.
    """
    out = ["seen long", "not_above long", "quantiles array<double>"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *out])
    at = [df.columns.index(k) for k in keys]
    column, names = df.columns.index(value), [*df.columns, "seen", "not_above", "quantiles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, SortedWindow(n)
        for batch in batches:
            keyed = zip(*(batch.column(i).to_pylist() for i in at), strict=True)
            seen, below, quantiles = [], [], []
            for now, v in zip(keyed, batch.column(column).to_pylist(), strict=True):
                if now != key:
                    key, window = now, SortedWindow(n)
                window.push(v if v is not None and v == v else None)
                seen.append(len(window.ordered))
                below.append(window.not_above(v) if v is not None and v == v else None)
                quantiles.append([window.quantile(q) for q in shares])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.int64()), pa.array(below, pa.int64()), pa.array(quantiles, pa.list_(pa.float64()))], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def rolling_ecdf(df: DataFrame, value: str, n: int, name: str = "ecdf", ax: Axis = AX) -> DataFrame:
    """df with the share, of n, of the last n values that don't exceed the present one, as ``rolling.rolling_ecdf`` has it by a gathered window.

    A null or NaN value has a share of 0.
    """
    found = rolling_order(df, [ax.name], ax.time, value, n)
    return found.withColumn(name, F.coalesce("not_above", F.lit(0)) / F.lit(float(n))).drop("seen", "not_above", "quantiles")


def spread_ecdf(df: DataFrame, keys: list[str], time: str = "date", window: int = 12, name: str = "signal") -> DataFrame:
    """df with the share of the full window's spreads that don't exceed the present one; null until the window is full of values."""
    found = rolling_order(df, keys, time, "spread", window)
    return found.withColumn(name, F.when(F.col("seen") >= window, F.coalesce("not_above", F.lit(0)) / F.lit(float(window)))).drop("seen", "not_above", "quantiles")
