"""Mathematics of score distributions held as array columns.

A mixture is three arrays pi, mu, sigma; a discrete distribution is an array
cdf with cdf[s] = P(score <= s). Ticks lie half a score above the integers.
Minus infinity stands for the logarithm of 0, as ln(0) is null in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: CDF values from here on count as 1; smaller ones than FLOOR, the error of the erf in use, as 0.
SNAP, FLOOR = 0.997, 1e-7
NEG_INF = float("-inf")
SQRT2, LOG_SQRT_2PI = math.sqrt(2.0), 0.5 * math.log(2 * math.pi)
# Abramowitz and Stegun 7.1.26, an approximation of erf.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is computed once, however often `of` reads it; inside lambdas Spark would compute it at every place."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _erf_of(x, exp, absolute, sign):
    t = 1.0 / (absolute(x) * ERF_P + 1.0)
    poly = t * 0.0
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return sign(x) * (poly * -1.0 * exp(x * x * -1.0) + 1.0)


def erf(x: Column) -> Column:
    return _erf_of(x, F.exp, F.abs, F.signum)


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    return (erf((x - mu) / (sigma * SQRT2)) + 1.0) * 0.5


def snap(cdf: Column) -> Column:
    """Values near 1 are 1 and values near 0 are 0."""
    return F.when(cdf >= SNAP, F.lit(1.0)).when(cdf < FLOOR, F.lit(0.0)).otherwise(cdf)


def _weighted(pi: str, *arrays: str, value) -> Column:
    """Sum over components of pi * value(components of arrays)."""
    parts = F.zip_with(pi, F.arrays_zip(*arrays), lambda p, c: p * value(*[c[a] for a in arrays]))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def cdf_at(score: Column | int, pi: str = "pi", mu: str = "mu", sigma: str = "sigma") -> Column:
    """P(score <= s) of a mixture at one tick; what a round of the search needs."""
    tick = (F.lit(score) if isinstance(score, int) else score) + 0.5
    return bound(_weighted(pi, mu, sigma, value=lambda m, s: normal_cdf(tick, m, s)), snap)


def mixture_cdf_columns(max_score: int, pi: str = "pi", mu: str = "mu", sigma: str = "sigma", first: int = 0) -> Column:
    """The CDF at the ticks from `first` to max_score - 1 as one expression; the twin of mixture_cdf."""
    return F.transform(F.sequence(F.lit(first), F.lit(max_score - 1)), lambda i: cdf_at(i, pi, mu, sigma))


def _numpy_cdf(pi: np.ndarray, mu: np.ndarray, sigma: np.ndarray, max_score: int, first: int = 0) -> np.ndarray:
    ticks = np.arange(first, max_score) + 0.5
    x = (ticks - mu[..., None]) / (sigma[..., None] * SQRT2)
    cdf = ((_erf_of(x, np.exp, np.abs, np.sign) + 1.0) * 0.5 * pi[..., None]).sum(-2)
    return np.where(cdf >= SNAP, 1.0, np.where(cdf < FLOOR, 0.0, cdf))


def mixture_cdf(mix: DataFrame, max_score: int, first: int = 0) -> DataFrame:
    """`mix` with cdf array<double> of the ticks from `first` to max_score - 1, in NumPy batches; rows may have any number of components."""

    @F.pandas_udf("array<double>")
    def run(pi: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
        out = np.empty(len(pi), object)
        sizes = pi.map(len).to_numpy()
        for m in np.unique(sizes):
            at = np.flatnonzero(sizes == m)
            stacked = [np.stack(x.iloc[at].to_numpy()) for x in (pi, mu, sigma)]
            for i, row in zip(at, _numpy_cdf(*stacked, max_score, first), strict=True):
                out[i] = row
        return pd.Series(out)

    return mix.withColumn("cdf", run("pi", "mu", "sigma"))


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NEG_INF))


def log_tables(df: DataFrame, cdf: str = "cdf") -> DataFrame:
    """`df` with log_cdf and log_pdf; pdf[0] = cdf[0], pdf[i] = cdf[i] - cdf[i-1], where steps below FLOOR count as 0.

    Of a CDF that begins at a later tick, the first element of log_pdf has no meaning.
    """
    steps = F.transform(cdf, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(F.col(cdf), i - 1)))
    return df.withColumns({"log_cdf": F.transform(cdf, safe_ln), "log_pdf": F.transform(steps, lambda p: safe_ln(F.when(p >= FLOOR, p).otherwise(0.0)))})


def mixture_mean(pi: str = "pi", mu: str = "mu") -> Column:
    return F.aggregate(F.zip_with(pi, mu, lambda p, m: p * m), F.lit(0.0), lambda acc, x: acc + x)


def mixture_moments(mix: DataFrame) -> DataFrame:
    """`mix` with mean and var of each mixture."""
    around = lambda mean: _weighted("pi", "mu", "sigma", value=lambda m, s: s * s + m * m - mean * mean)
    return mix.withColumns({"mean": mixture_mean(), "var": bound(mixture_mean(), around)})


def logsumexp(values: Column) -> Column:
    """ln of the sum of exponentials; minus infinity where all are."""

    def below(v: Column, top: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(top + F.ln(total))

    return bound(values, lambda v: bound(F.array_max(v), lambda top: below(v, top)))


def mixture_nll(score: Column, pi: str = "pi", mu: str = "mu", sigma: str = "sigma", weight: Column | None = None) -> Column:
    """Negative log likelihood of a score, times the weight of that score if one is given."""
    log_normal = lambda m, s: ((score - m) / s) * ((score - m) / s) * -0.5 - F.ln(s) - LOG_SQRT_2PI
    terms = F.zip_with(pi, F.arrays_zip(mu, sigma), lambda p, c: safe_ln(p) + log_normal(c[mu], c[sigma]))
    nll = -logsumexp(terms)
    return nll if weight is None else nll * weight


def hypotheses_to_mixture(df: DataFrame, h: str = "h", z: str = "z") -> DataFrame:
    """Mixture parameters from score hypotheses h[H] and component scores z[M][H].

    gamma is the softmax of z over the components; pi its mean over hypotheses,
    mu and sigma the gamma-weighted mean and deviation of h. Sums and variances are kept off 0 by 1e-4.
    """
    small = 1e-4

    @F.pandas_udf("struct<pi:array<double>,mu:array<double>,sigma:array<double>>")
    def run(h_col: pd.Series, z_col: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({c: pd.Series([None] * len(h_col), dtype="object") for c in ("pi", "mu", "sigma")})
        shapes = pd.Series([(len(z), len(h)) for h, z in zip(h_col, z_col, strict=True)], dtype="object")
        for shape in set(shapes):  # rows of one shape are computed together
            at = np.flatnonzero([x == shape for x in shapes])
            hyp = np.stack([np.asarray(h_col.iloc[i], float) for i in at])[:, None, :]
            comp = np.stack([np.stack(z_col.iloc[i]).astype(float) for i in at])
            gamma = np.exp(comp - comp.max(1, keepdims=True))
            gamma /= gamma.sum(1, keepdims=True)
            total = gamma.sum(2) + small
            mu = (gamma * hyp).sum(2) / total
            var = (gamma * (hyp - mu[..., None]) ** 2).sum(2) / total + small
            for name, rows in (("pi", gamma.mean(2)), ("mu", mu), ("sigma", np.sqrt(var))):
                for i, row in zip(at, rows, strict=True):
                    out.at[i, name] = row
        return out

    return df.withColumn("mixture", run(h, z)).select(*df.columns, "mixture.*")


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")
