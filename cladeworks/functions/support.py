"""Branch support from quartet frequencies: posterior, length, p-value, and how they are written after a node."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction, the least quotient that counts as converged, and what counts as zero.
TERMS, EPS, ZERO = 10_000, 1e-15, 2.22e-16


def _lgamma(x):
    return np.array([math.lgamma(v) for v in x])


def incomplete_beta(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of each pair of ``a`` and ``b``, by its continued fraction in Lentz's form."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    shape, a, b = a.shape, a.ravel(), b.ravel()
    if x <= 0 or x >= 1:
        return np.full(shape, float(x >= 1))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    floor = 1e-300
    away = lambda v: np.where(v == 0, floor, v)
    c, d = np.ones(len(a)), 1 / away(1 - (a + b) * x / (a + 1))
    value, left = d.copy(), np.arange(len(a))
    for m in range(1, TERMS):
        p, q, y = a[left], b[left], x[left]
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[left] = 1 / away(1 + top * d[left])
            c[left] = away(1 + top / c[left])
            value[left] *= c[left] * d[left]
        left = left[np.abs(c[left] * d[left] - 1) >= EPS]
        if not len(left):
            found = front * value
            return np.where(swap, 1 - found, found).reshape(shape)
    raise ArithmeticError("the continued fraction does not converge")


def posterior_of(f1, f2, f3, n, lam: float) -> np.ndarray:
    """The main topology's share of the three topologies' marginal likelihoods; 0 if its own is 0."""
    f1, f2, f3, n = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (f1, f2, f3, n)))

    def log_g(v):
        g = incomplete_beta(2 / 3, n - v + 2 * lam, v + 1)  # one minus that of 1/3, without cancellation
        return np.where(g > ZERO, np.log(np.maximum(g, ZERO)), -np.inf)

    base = _lgamma(f1 + 1) + _lgamma(n - f1 + 2 * lam)
    own, total = log_g(f1), np.ones(len(f1))
    known = np.isfinite(own)
    for m in (f2, f3):
        log = log_g(m) + math.log(2) * (m - f1) + _lgamma(m + 1) + _lgamma(n - m + 2 * lam) - base - np.where(known, own, 0)
        total += np.where(log < 700, np.exp(np.minimum(log, 700)), np.inf)
    return np.where(known, 1 / total, 0.0)


def posterior(f1: Column, f2: Column, f3: Column, n: Column, lam: float = 0.5) -> Column:
    """Posterior probability of the main topology of each branch; null if n is null or less than 1."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out, there = pd.Series(np.nan, index=a.index), d >= 1
        if there.any():
            out[there] = posterior_of(a[there], b[there], c[there], d[there], lam)
        return out

    return run(f1.cast("double"), f2.cast("double"), f3.cast("double"), n.cast("double"))


def branch_length(f1: Column, n: Column, lam: float = 0.5) -> Column:
    """Length in coalescent units; 0 if no more than a third of the quartets agree."""
    share = f1 / (n + F.lit(2 * lam))
    return F.when(share > 1 / 3, -F.log(1.5 * (1 - share))).otherwise(F.lit(0.0))


def p_value(f1: Column, f2: Column, f3: Column, n: Column) -> Column:
    """Probability of the three frequencies if they were equal (chi-squared, 2 degrees of freedom); null up to 15 quartets."""
    third = n / F.lit(3.0)
    chi = sum(((f - third) * (f - third) / third for f in (f2, f3)), (f1 - third) * (f1 - third) / third)
    return F.when(n > 15, F.exp(-chi / 2))


def plain(x: Column) -> Column:
    """At most four decimals, without zeros at the end."""
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.bround(x, 4)), "0+$", ""), r"\.$", ""))


def annotation(kind: str, pp: Column, bl: Column, pv: Column, f: list[Column], n: Column) -> Column:
    """Text after a node. kind: posterior, length, both, pvalue, detailed or all; a missing p-value is NA, or NaN in all."""
    fixed = lambda x, k=4: F.when(x.isNotNull(), F.format_string(f"%.{k}f", x.cast("double")))
    counts = f and [F.lit(";f1="), fixed(f[0], 1), F.lit(";f2="), fixed(f[1], 1), F.lit(";f3="), fixed(f[2], 1), F.lit(";EN="), fixed(n, 1)]
    if kind == "posterior":
        return plain(pp)
    if kind == "length":
        return plain(bl)
    if kind == "both":
        return F.concat(plain(pp), F.lit(":"), plain(bl))
    if kind == "pvalue":
        return F.coalesce(plain(pv), F.lit("NA"))
    if kind == "detailed":
        return F.concat(F.lit("'[pp="), fixed(pp), *counts, F.lit("]'"))
    if kind == "all":
        return F.concat(F.lit("'[pp="), fixed(pp), F.lit(";bl="), fixed(bl), *counts, F.lit(";pval="), F.coalesce(fixed(pv), F.lit("NaN")), F.lit("]'"))
    raise ValueError(f"no such annotation: {kind}")
