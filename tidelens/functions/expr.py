"""Null-safe arithmetic. Undefined results are NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def rnd(x, digits: int = 6) -> Column:
    """Round for output; adding 0.0 turns a negative zero into zero."""
    return F.round(c(x), digits) + F.lit(0.0)


def rnd_up(x, digits: int = 6) -> Column:
    """Round after a nudge of 1e-9, so that exact decimal ties fall on one side."""
    return F.round(c(x) + 1e-9, digits) + F.lit(0.0)


def rounded(df, cols, digits: int = 6):
    return df.withColumns({k: rnd(k, digits) for k in cols})


def log_safe(x) -> Column:
    x = c(x)
    return F.when(x > 0, F.log(x))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(c(x), c(lo)), c(hi))


def pos(x) -> Column:
    """Positive part, NULL kept."""
    x = c(x)
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def neg(x) -> Column:
    """Size of the negative part, NULL kept."""
    x = c(x)
    return F.when(x < 0, -x).when(x.isNotNull(), F.lit(0.0))


def sqrt_safe(x) -> Column:
    x = c(x)
    return F.when(x >= 0, F.sqrt(x))


def json_num(col, path: str) -> Column:
    return F.get_json_object(c(col), path).try_cast("double")
