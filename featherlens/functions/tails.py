"""Tail probabilities, for which Spark has no function: Arrow batches through vectorised series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
ROUNDS, TINY = 300, 1e-300


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    keep = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, ROUNDS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + step * d)
            c = keep(1 + step / c)
            out *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    inside = np.clip(x, TINY, 1 - 1e-16)
    front = np.exp((_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(np.float64) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)
    part = front * _fraction(p, q, z) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def normal_tails(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2)).astype(np.float64)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom; NULL without either or for no degrees."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
        tv, n = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
        return pd.Series(np.where(ok, incomplete_beta(n / 2, np.full(len(n), 0.5), n / (n + tv * tv)), np.nan)).replace({np.nan: None}).astype("Float64")

    return tail(t.cast("double"), df.cast("double"))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|); NULL for NULL."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        ok = z.notna().to_numpy()
        p = normal_tails(np.where(ok, z, 0.0).astype(np.float64))
        return pd.Series(np.where(ok, p, np.nan)).replace({np.nan: None}).astype("Float64")

    return tail(z.cast("double"))


def mann_whitney_counts(few: int, many: int, top: int) -> np.ndarray:
    """Of the orders of two samples without ties, how many have U = 0..top: the coefficients of the Gaussian binomial.

    One factor (1 - q^(many + i)) / (1 - q^i) after another; entries up to top only hang on those before them, so the tail's
    small counts are exact.
    """
    c = np.zeros(top + 1)
    c[0] = 1
    for i in range(1, few + 1):
        if many + i <= top:
            c[many + i :] -= c[: -(many + i)].copy()
        for first in range(min(i, top + 1)):
            c[first::i] = np.cumsum(c[first::i])
    return c


def mann_whitney_exact(u: Column, n1: Column, n0: Column) -> Column:
    """Two-sided P of U under the exact law of samples without ties; NULL where an argument is. One side should be small."""

    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        out = np.full(len(u), np.nan)
        known = (u.notna() & n1.notna() & n0.notna()).to_numpy()
        rows = pd.DataFrame({"u": np.minimum(u, n1 * n0 - u), "a": np.minimum(n1, n0), "b": np.maximum(n1, n0)})[known]
        for (a, b), group in rows.groupby(["a", "b"]):
            counts = np.cumsum(mann_whitney_counts(int(a), int(b), int(group["u"].max())))
            out[group.index] = np.minimum(1.0, 2 * counts[group["u"].astype(int)] / math.comb(int(a + b), int(a)))
        return pd.Series(out).replace({np.nan: None}).astype("Float64")

    return tail(u.cast("double"), n1.cast("double"), n0.cast("double"))


#: Terms of a tail that are held at once.
TERMS = 1 << 16


def hypergeometric_sum(n: int, k: int, d: int, hits: int) -> float:
    """P[X >= hits] for d drawn of n with k marked: a first term, and each next one by its ratio to the one before."""
    log_c = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    first, last = max(hits, 0, k + d - n), min(k, d)
    if first > last:
        return 0.0
    log_p, total = log_c(k, first) + log_c(n - k, d - first) - log_c(n, d), 0.0
    for low in range(first, last + 1, TERMS):
        x = np.arange(low, min(low + TERMS, last + 1), dtype=np.float64)
        steps = np.log((k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1)), where=(x < k) & (x < d), out=np.zeros(len(x)))
        logs = log_p + np.concatenate([[0.0], np.cumsum(steps)])
        total += float(np.exp(logs[:-1]).sum())
        log_p = logs[-1]
    return min(1.0, total)


def hypergeometric_upper(population: Column, marked: Column, drawn: Column, hits: Column) -> Column:
    """P[X >= hits]; NULL without an argument or for a count over its population."""

    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series, d: pd.Series, hits: pd.Series) -> pd.Series:
        ok = (n.notna() & k.notna() & d.notna() & hits.notna() & (k <= n) & (d <= n) & (k >= 0) & (d >= 0)).to_numpy()
        args = zip(*(v[ok].astype("int64") for v in (n, k, d, hits)), strict=True)
        out = np.full(len(n), np.nan)
        out[ok] = [hypergeometric_sum(*a) for a in args]
        return pd.Series(out).replace({np.nan: None}).astype("Float64")

    return tail(*(c.cast("long") for c in (population, marked, drawn, hits)))
