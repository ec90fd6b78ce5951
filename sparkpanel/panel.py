"""The panel: a table of many entities over time, named by its two key columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Names of a panel's time and entity columns, and the windows they give."""

    time: str = "date"
    name: str = "name"

    def rows(self, start: int | None, end: int | None) -> WindowSpec:
        """Rows of one entity from ``start`` to ``end`` around each row; None is unbounded."""
        low = Window.unboundedPreceding if start is None else start
        high = Window.unboundedFollowing if end is None else end
        return self.history().rowsBetween(low, high)

    def history(self) -> WindowSpec:
        return Window.partitionBy(self.name).orderBy(self.time)

    def entity(self) -> WindowSpec:
        return Window.partitionBy(self.name)

    def section(self, *more: str) -> WindowSpec:
        """The cross-section of one time."""
        return Window.partitionBy(self.time, *more)


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y; null where y is zero."""
    return F.try_divide(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)


def log_growth(r: Column | str) -> Column:
    """ln(1 + r); null where a return is -100 % or less, so sums skip it."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when(r > -1, F.log(1 + r))
