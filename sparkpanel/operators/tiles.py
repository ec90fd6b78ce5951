"""Statistics of all pairs of entities from block products: no row of a pair is formed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Axis, ratio

AX = Axis()

#: Names and times of a tile; a task holds two of them.
TILE_NAMES, TILE_TIMES = 128, 512
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrices(cells: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a tile, its values (0 where there are none) and which are there."""
    names, row = np.unique([c["name"] for c in cells], return_inverse=True)
    values, there = np.zeros((len(names), TILE_TIMES)), np.zeros((len(names), TILE_TIMES))
    at = np.array([c["t"] for c in cells])
    values[row, at], there[row, at] = [c["v"] for c in cells], 1.0
    return names, values, there


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of every pair of names of two tiles over their common times; x is the later name."""
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (a, va, pa_), (b, vb, pb) = _matrices(left), _matrices(right)
            sums = {"n": pa_ @ pb.T, "sx": va @ pb.T, "sy": pa_ @ vb.T, "sxx": (va * va) @ pb.T, "syy": pa_ @ (vb * vb).T, "sxy": va @ vb.T}
            # tiles of one block meet once: each pair is there twice, in both orders, and one of them is taken
            own = np.array_equal(a, b)
            i, j = np.nonzero((sums["n"] > 0) & ((a[:, None] > b[None, :]) if own else np.ones((len(a), len(b)), bool)))
            later = a[i] > b[j]
            swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
            cells = [np.where(later, sums[c][i, j], sums[swapped.get(c, c)][i, j]) for c in _SUMS]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later, a[i], b[j])), pa.array(np.where(later, b[j], a[i])), *map(pa.array, cells)], ["x", "y", *_SUMS])


def pair_moments(prices: DataFrame, value: str = "price", names: int = TILE_NAMES, ax: Axis = AX) -> DataFrame:
    """One row for each pair of names with common times (x the later, y the earlier): n, correlation, the regression of y on x and the spread's deviation.

    Columns: x, y, n, correlation, hedge_ratio, intercept, spread_std (of y - hedge_ratio x, sample).
    Prices lie in tiles of ``names`` names by TILE_TIMES times; tiles of the same times
    meet, and six matrix products give the sums of all their pairs. So each value is shuffled once for each block of
    names, and what is formed for a pair is its six sums for each block of times. Null and
    NaN values are missing; of several rows of a name and time the largest value counts. Statistics without spread are null.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = prices.select(F.col(ax.name).cast("string").alias("name"), F.col(ax.time).alias("time"), v.alias("v")).dropna()
    rows = rows.groupBy("name", "time").agg(F.max("v").alias("v"))
    # about each name's mean, so that sums of squares keep their digits
    rows = rows.withColumn("mean", F.avg("v").over(Window.partitionBy("name"))).withColumn("v", F.col("v") - F.col("mean"))
    means = rows.select("name", "mean").distinct()
    blocks = max(1, -(-means.count() // names))
    times = rows.select("time").distinct().withColumn("i", F.row_number().over(Window.orderBy("time")) - 1)  # the calendar
    placed = rows.join(times, "time").select(
        F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block"), F.floor(F.col("i") / TILE_TIMES).alias("span"), F.struct("name", (F.col("i") % TILE_TIMES).alias("t"), "v").alias("cell")
    )
    tiles = placed.groupBy("block", "span").agg(F.collect_list("cell").alias("cells"))  # names times TILE_TIMES cells, about
    other = tiles.select("span", F.col("block").alias("other"), F.col("cells").alias("more"))
    met = tiles.join(other, "span").filter(F.col("block") <= F.col("other")).select("cells", "more")
    each = met.mapInArrow(_products, "x string, y string, " + ", ".join(f"{c} double" for c in _SUMS))
    s = each.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in _SUMS])
    mean_of = lambda side: means.select(F.col("name").alias(side), F.col("mean").alias(f"mean_{side}"))
    s = s.join(mean_of("x"), "x").join(mean_of("y"), "y")
    n = F.col("n")
    vx, vy, cov = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    # under the rounding of its sums a series doesn't vary
    flat = lambda var, square: F.when(var > F.col(square) * 1e-14, var)
    s = s.select("x", "y", n.cast("long").alias("n"), "sx", "sy", "mean_x", "mean_y", flat(vx, "sxx").alias("vx"), flat(vy, "syy").alias("vy"), cov.alias("cov"))
    slope = ratio("cov", "vx")
    level = (F.col("sy") / F.col("n") + F.col("mean_y")) - F.col("hedge_ratio") * (F.col("sx") / F.col("n") + F.col("mean_x"))
    left = F.greatest(F.coalesce("vy", F.lit(0.0)) - F.col("hedge_ratio") * F.col("cov"), F.lit(0.0))
    s = s.withColumns({"correlation": ratio(F.col("cov"), F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))), "hedge_ratio": slope})
    return s.select("x", "y", "n", "correlation", "hedge_ratio", level.alias("intercept"), F.when(F.col("hedge_ratio").isNotNull(), F.sqrt(ratio(left, F.col("n") - 1))).alias("spread_std"))
