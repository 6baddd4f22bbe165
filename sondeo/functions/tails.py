"""Tail probabilities and the small solves behind the tests; scalars only, no table data.

Public statistics: incomplete beta by its continued fraction, the Dickey-Fuller surface of MacKinnon (1994),
the level-stationarity table of Kwiatkowski et al. (1992), Levinson-Durbin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Level-stationarity critical values and their p-values.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P_VALUES = (0.10, 0.05, 0.025, 0.01)
# Unit-root surface, constant term, one series.
TAU_MAX, TAU_MIN, TAU_SWITCH = 2.74, -18.83, -1.61
TAU_LEFT = (2.1659, 1.4412, 0.038269)
TAU_RIGHT = (1.7339, 0.93202, -0.12745, -0.010368)


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if math.isnan(x):
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, 10_000):
        step = 1.0
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_tail(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _vectorised(scalar, *columns: pd.Series) -> pd.Series:
    rows = zip(*[c.astype(float) for c in columns])
    return pd.Series([None if any(math.isnan(v) for v in row) else scalar(*row) for row in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; applied to result rows only."""
    return _vectorised(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p of an F statistic; applied to result rows only."""
    return _vectorised(f_upper, f, d1, d2)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: the power series below a + 1, the continued fraction of the tail above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    # successive numerators and denominators of the fraction, kept near 1
    p0, q0, p1, q1 = 0.0, 1.0, 1.0, x + 1 - a
    value = p1 / q1
    for k in range(1, 10_000):
        weight, step = k * (a - k), x + 2 * k + 1 - a
        p0, q0, p1, q1 = p1 / q1, 1.0, (step * p1 + weight * p0) / q1, step + weight * q0 / q1
        before, value = value, p1 / q1
        if abs(value - before) <= abs(value) * 1e-15:
            break
    return scale * value


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of a chi-square statistic; applied to result rows only."""
    return _vectorised(lambda x, df: gamma_upper(df / 2.0, x / 2.0), x, df)


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal statistic; applied to result rows only."""
    return _vectorised(lambda z: math.erfc(abs(z) / math.sqrt(2.0)), z)


def unit_root_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = TAU_LEFT if tau <= TAU_SWITCH else TAU_RIGHT
    z = sum(c * tau**i for i, c in enumerate(terms))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def level_p(statistic: float) -> float:
    return float(np.interp(statistic, KPSS_CRITICAL, KPSS_P_VALUES))


# What is left of 1 after a perfect fit is rounding error; a division by it would be noise.
SINGULAR = 1e-9


def partial_autocorrelations(r: list[float]) -> list[float]:
    """Levinson-Durbin on autocorrelations r[0..k] (r[0] = 1): the last coefficient of every order.

    From the order on at which the values before explain the series completely, or at which these r, whose denominators
    differ, are those of no series (a coefficient beyond 1), there is none: NaN.
    """
    out, phi = [1.0], np.empty(0)
    for k in range(1, len(r)):
        past = np.asarray(r[1:k])
        rest = 1.0 - phi @ past
        last = (r[k] - phi @ past[::-1]) / rest if rest > SINGULAR * (1.0 + np.abs(phi) @ np.abs(past)) else math.nan
        if not abs(last) <= 1.0:
            return out + [math.nan] * (len(r) - k)
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out
