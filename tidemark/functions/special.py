"""Tail probabilities of the two drift tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_pvalue(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, clipped to [0, 1]."""
    scaled = n.cast("double") * m.cast("double") / (n + m)
    lam2 = scaled * statistic * statistic

    def step(acc: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return acc + sign * F.exp(F.lit(-2.0) * k * k * lam2)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), step)
    return F.when(lam2 < 1e-3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction, run to convergence."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i, step = d, 0, 0.0
    while abs(step - 1) > 1e-15:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
    return min(1.0, front * h)


def _chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    def tail(x, k):
        if pd.isna(x) or pd.isna(k):
            return None
        return 1.0 if x <= 0 or k < 1 else upper_gamma(k / 2, x / 2)

    return pd.Series([tail(x, k) for x, k in zip(statistic, dof)], dtype="float64")


def chi2_pvalue(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution, by one rule for any number of degrees of freedom.

    The input has one row per tested column, so a small function over batches of it is in place.
    """
    return F.pandas_udf(_chi2_tail, "double")(statistic.cast("double"), dof.cast("double"))
