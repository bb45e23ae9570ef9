"""Rolling-frame columns over one block of a numbered series.

All of these use the same window specification - partition (symbol, block), order
by row number - so any number of them share one exchange and one sort.
A rolling value is NULL until ``n`` non-null values are in the frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .expr import c, div


def block_window():
    return Window.partitionBy("symbol", "_blk").orderBy("_rn")


def frame(n: int):
    return block_window().rowsBetween(-(n - 1), 0)


def lag(x, k: int = 1) -> Column:
    return F.lag(c(x), k).over(block_window())


def lead(x, k: int = 1) -> Column:
    return F.lead(c(x), k).over(block_window())


def roll(agg: Callable[..., Column], x, n: int) -> Column:
    x, w = c(x), frame(n)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def roll2(agg: Callable[..., Column], x, y, n: int) -> Column:
    """Two-argument rolling aggregate (corr, regression) with the full-frame guard."""
    x, y, w = c(x), c(y), frame(n)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1))).over(w)
    return F.when(both == n, agg(x, y).over(w))


def mean(x, n):
    return roll(F.avg, x, n)


def total(x, n):
    return roll(F.sum, x, n)


def std(x, n):
    return roll(F.stddev_samp, x, n)


def var(x, n):
    return roll(F.var_samp, x, n)


def high(x, n):
    return roll(F.max, x, n)


def low(x, n):
    return roll(F.min, x, n)


def quantile(x, n, p):
    """Interpolated quantile of a full frame of ``n`` rows: sort the frame, read two places."""
    x, w = c(x), frame(n)
    items, at = F.sort_array(F.collect_list(x).over(w)), (n - 1) * p
    lo = int(at)
    a, b = F.get(items, F.lit(lo)), F.get(items, F.lit(min(lo + 1, n - 1)))
    return F.when(F.count(x).over(w) == n, a + (b - a) * (at - lo))


def diff(x, k: int = 1) -> Column:
    return c(x) - lag(x, k)


def pct(x, k: int = 1) -> Column:
    return div(diff(x, k), lag(x, k))
