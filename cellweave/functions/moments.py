"""Moments of small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments5(values: Column, textbook: bool = False) -> dict[str, Column]:
    """max, mean, variance (n - 1), skewness and kurtosis of an array of doubles; all 0 if its largest is 0.

    The deviation that skewness and kurtosis are divided by is half the variance, or with ``textbook`` its root.
    """
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    power = lambda p: F.aggregate(values, F.lit(0.0), lambda a, x: a + _power(x - mean, p))
    var = F.try_divide(power(2), n - F.lit(1.0))
    sd = F.sqrt(var) if textbook else var * F.lit(0.5)
    top = F.array_max(values)
    out = {"max": top, "mean": mean, "var": var, "skew": F.try_divide(power(3) / n, _power(sd, 3)), "kurt": F.try_divide(power(4) / n, _power(sd, 4))}
    return {k: F.when(top == 0, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0))) for k, x in out.items()}


def _power(x: Column, p: int) -> Column:
    out = x
    for _ in range(p - 1):
        out = out * x
    return out
