"""Unit-root and level-stationarity tests and their joint reading.

Both tests need only sums over the sequence: products of values and differences a few rows apart, edge values,
and squared running sums. Spark computes those per block; the driver solves systems of about a hundred
unknowns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.tails import SINGULAR, level_p, unit_root_p
from sondeo.plans.sequence import Sequence, block_of, in_block, lag_products

# Minimum length, significance, spread that suggests a log.
MIN_ROWS, SIGNIFICANCE, LOG_SPREAD = 10, 0.05, 0.5

TEST_SCHEMA = "series string, statistic double, p_value double, lags int, stationary boolean, reason string"


def _columns(seq: Sequence, columns: Seq[str] | None) -> list[str]:
    usable = seq.usable(MIN_ROWS)
    return usable if columns is None else [c for c in columns if c in usable]


@dataclass
class SequenceSums:
    """What both tests need: lag sums of every varying series, scaled to mean 0 and spread 1."""

    names: list[str]
    scale: dict[str, tuple[float, float]]
    max_lag: int
    totals: dict[tuple[str, str, int], float]

    def lags(self, series: str, kind: str, upto: int) -> np.ndarray:
        return np.array([self.totals.get((series, kind, k), 0.0) for k in range(upto + 1)])


def _scaled(seq: Sequence, scale: dict[str, tuple[float, float]]) -> DataFrame:
    rows = [(c, m, s) for c, (m, s) in scale.items()]
    factors = F.broadcast(seq.table.sparkSession.createDataFrame(rows, "series string, _m double, _s double"))
    y = (F.col("y") - F.col("_m")) / F.col("_s")
    return seq.series(list(scale)).join(factors, "series").select("series", "pos", y.alias("y"))


def _lag_totals(seq: Sequence, scale, max_lag: int, differences: bool) -> dict[tuple[str, str, int], float]:
    found = lag_products(_scaled(seq, scale), max_lag, seq.block_rows, differences).collect()  # numbers per lag
    return {(r["series"], r["kind"], r["lag"]): r["total"] for r in found}


def sequence_sums(seq: Sequence, columns: Seq[str] | None = None) -> SequenceSums:
    """Two passes: mean and spread, then all lag sums that the tests start from."""
    names = _columns(seq, columns)
    max_lag = max(max_adf_lag(seq.n), kpss_start(seq.n))
    if not names:
        return SequenceSums(names, {}, max_lag, {})
    rows = seq.series(names).groupBy("series").agg(
        F.avg("y").alias("m"), F.stddev_pop("y").alias("s"), F.min("y").alias("lo"), F.max("y").alias("hi")
    ).collect()  # one row per series
    scale = {r["series"]: (r["m"], r["s"]) for r in rows if r["hi"] > r["lo"] and r["s"] > 0}
    return SequenceSums(names, scale, max_lag, _lag_totals(seq, scale, max_lag, True) if scale else {})


# --- augmented Dickey-Fuller -------------------------------------------------------------------------------


def max_adf_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


@dataclass
class _Moments:
    """Whole-sequence sums of one scaled series y and its differences, and its values at both ends."""

    n: int
    diff_lags: np.ndarray  # sum of diff[t] * diff[t-k]
    cross_lags: np.ndarray  # sum of y[t] * diff[t-k]
    total: float
    squares: float
    head: np.ndarray  # y[0..m+1]
    tail: np.ndarray  # y[n-m-2..n-1]


def _adf_moments(seq: Sequence, sums: SequenceSums, m: int) -> dict[str, _Moments]:
    n, reach = seq.n, m + 2
    near = (F.col("pos") < reach) | (F.col("pos") >= n - reach)
    edge: dict[str, dict[int, float]] = {c: {} for c in sums.scale}
    for r in _scaled(seq, sums.scale).where(near).collect():  # 2 (m + 2) rows per series
        edge[r["series"]][r["pos"]] = r["y"]
    return {
        c: _Moments(
            n, sums.lags(c, "dd", m), sums.lags(c, "yd", m), sums.totals[(c, "y", 0)], sums.totals[(c, "yy", 0)],
            np.array([edge[c][i] for i in range(min(reach, n))]),
            np.array([edge[c][i] for i in range(max(0, n - reach), n)]),
        )
        for c in sums.scale
    }


def _gram(q: _Moments, m: int) -> np.ndarray:
    """Cross products of [1, y[t-1], diff[t-1], .., diff[t-m], diff[t]] over t = m+1 .. n-1.

    Whole-sequence sums minus the few terms at the ends that lie outside each shifted range.
    """
    y, d = q.head[: m + 1], np.diff(q.head[: m + 1], prepend=0.0)  # d[t] for t = 1..m; d[0] is unused
    tail, last = q.tail[::-1], q.tail[-1]  # tail[i] = y[n-1-i]
    late = tail[: m + 1] - tail[1 : m + 2]  # late[i] = diff[n-1-i]
    first = [q.diff_lags[k] - d[k + 1 :] @ d[1 : m + 1 - k] for k in range(m + 1)]
    # moving both factors one row back adds the term before the range and drops the one at its end
    lagged = np.empty((m + 1, m + 1))
    lagged[0] = first
    lagged[:, 0] = first
    early = d[:0:-1]  # early[i] = diff[m-i]
    for i in range(m):
        lagged[i + 1, 1:] = lagged[i, :-1] + early[i] * early - late[i] * late[:m]
    sums = tail[: m + 1] - y[::-1]  # sum of diff[t-j]
    cross = np.empty(m + 1)  # y[t-1] * diff[t-j]
    cross[0] = (last**2 - y[m] ** 2 - (q.diff_lags[0] - d[1:] @ d[1:])) / 2
    for j in range(1, m + 1):
        cross[j] = q.cross_lags[j - 1] - y[j:m] @ d[1 : m - j + 1] - last * late[j - 1]
    g = np.empty((m + 3, m + 3))
    place = [m + 2, *range(2, m + 2)]  # diff[t] goes last
    g[0, 0] = q.n - 1 - m
    g[0, 1] = g[1, 0] = q.total - y[:m].sum() - last
    g[1, 1] = q.squares - y[:m] @ y[:m] - last**2
    g[0, place] = g[place, 0] = sums
    g[1, place] = g[place, 1] = cross
    g[np.ix_(place, place)] = lagged
    return g


def _adf_statistic(q: _Moments, m: int) -> tuple[float, int]:
    """Lag count by AIC on the common sample, then the statistic on the chosen lag's own sample."""
    whole = _gram(q, m)
    factor = np.linalg.cholesky(whole)
    # what a regressor adds to those before it is rounding error: the series explains itself
    if np.min(np.diag(factor)[:-1] ** 2 / np.diag(whole)[:-1]) <= SINGULAR:
        raise np.linalg.LinAlgError("singular")
    rows = q.n - 1 - m
    explained = np.cumsum(factor[-1, :-1] ** 2)
    total = explained[-1] + factor[-1, -1] ** 2
    scores = []
    for p in range(m + 1):
        residual = max(total - explained[p + 1], 1e-300)
        likelihood = -rows / 2 * (math.log(2 * math.pi * residual / rows) + 1)
        scores.append(-2 * likelihood + 2 * (p + 2))
    p = int(np.argmin(scores))
    g = _gram(q, p)
    x, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    inverse = np.linalg.inv(x)
    beta = inverse @ xy
    variance = (yy - beta @ xy) / (q.n - 1 - p - len(beta))
    return float(beta[1] / math.sqrt(variance * inverse[1, 1])), p


def adf_test(seq: Sequence, columns: Seq[str] | None = None, sums: SequenceSums | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a constant. NULL statistic and a reason for a series it cannot judge."""
    sums = sums or sequence_sums(seq, columns)
    m = max_adf_lag(seq.n)
    moments = _adf_moments(seq, sums, m) if sums.scale else {}
    rows = []
    for c in sums.names:
        if c not in moments:
            rows.append((c, None, None, None, None, "constant"))
            continue
        try:
            tau, p = _adf_statistic(moments[c], m)
            value = unit_root_p(tau)
            rows.append((c, tau, value, p, value < SIGNIFICANCE, None))
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            rows.append((c, None, None, None, None, "singular"))
    return seq.table.sparkSession.createDataFrame(rows, TEST_SCHEMA)


# --- level stationarity ------------------------------------------------------------------------------------


def squared_running_sums(deviations: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(series, eta): sum of squared running sums of the deviations, over n squared.

    Running sums are taken inside blocks; a carry per block turns them into whole-sequence sums.
    """
    inside = deviations.withColumn("block", block_of(block_rows))
    frame = in_block().rowsBetween(Window.unboundedPreceding, 0)
    running = inside.withColumn("run", F.sum("y").over(frame))
    blocks = running.groupBy("series", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("sum"), F.sum("run").alias("run"),
        F.sum(F.col("run") * F.col("run")).alias("run2"),
    )
    # one row per block
    before = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carry", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    square = F.col("rows") * F.col("carry") * F.col("carry") + 2 * F.col("carry") * F.col("run") + F.col("run2")
    return carried.groupBy("series").agg((F.sum(square) / (float(n) * n)).alias("eta"))


def kpss_start(n: int) -> int:
    return int(n ** (2.0 / 9.0))


def kpss_lag(sums: Seq[float], n: int) -> int:
    """Automatic bandwidth from the first n^(2/9) lag sums."""
    c = kpss_start(n)
    s0 = sums[0] / n + sum(2.0 * sums[i] / n for i in range(1, c + 1))
    s1 = sum(i * 2.0 * sums[i] / n for i in range(1, c + 1))
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)


def kpss_test(seq: Sequence, columns: Seq[str] | None = None, sums: SequenceSums | None = None) -> DataFrame:
    """Level-stationarity test with automatic bandwidth. NULL statistic and a reason for a constant series."""
    sums = sums or sequence_sums(seq, columns)
    n, rows = seq.n, [(c, None, None, None, None, "constant") for c in sums.names if c not in sums.scale]
    if sums.scale:
        lags = {c: kpss_lag(sums.lags(c, "yy", kpss_start(n)), n) for c in sums.scale}
        widest = max(lags.values())
        if widest > sums.max_lag:
            # a strongly dependent series asks for a wider window than the first pass covered
            sums = SequenceSums(sums.names, sums.scale, widest, _lag_totals(seq, sums.scale, widest, False))
        etas = {r["series"]: r["eta"] for r in squared_running_sums(_scaled(seq, sums.scale), n, seq.block_rows).collect()}
        for c, k in lags.items():
            products = sums.lags(c, "yy", k)
            weights = 1 - np.arange(1, k + 1) / (k + 1)
            statistic = float(etas[c] / ((products[0] + 2 * weights @ products[1:]) / n))
            p = level_p(statistic)
            rows.append((c, statistic, p, k, p > SIGNIFICANCE, None))
    return seq.table.sparkSession.createDataFrame(rows, TEST_SCHEMA)


# --- joint reading -----------------------------------------------------------------------------------------


def joint_verdict(adf: DataFrame, kpss: DataFrame) -> DataFrame:
    """(series, adf_stationary, kpss_stationary, verdict); NULL verdict if a test could not judge."""
    a, k = F.col("adf_stationary"), F.col("kpss_stationary")
    verdict = (
        F.when(a & k, "stationary").when(~a & ~k, "unit_root").when(a & ~k, "trend_stationary")
        .when(~a & k, "difference_stationary")
    )
    left = adf.select("series", F.col("stationary").alias("adf_stationary"))
    right = kpss.select("series", F.col("stationary").alias("kpss_stationary"))
    return left.join(F.broadcast(right), "series").withColumn("verdict", verdict)  # one row per series


def recommend_transform(seq: Sequence, verdicts: DataFrame) -> DataFrame:
    """(series, verdict, transform): what makes the series stationary, with a log for wide positive series."""
    names = [r["series"] for r in verdicts.select("series").collect()]
    shape = seq.series(names).groupBy("series").agg(
        F.min("y").alias("low"), F.try_divide(F.stddev_samp("y"), F.avg("y")).alias("spread")
    )
    base = (
        F.when(F.col("verdict") == "stationary", "none").when(F.col("verdict") == "trend_stationary", "detrend")
        .when(F.col("verdict").isNotNull(), "first_difference")
    )
    wide = (F.col("low") > 0) & (F.col("spread") > LOG_SPREAD) & (F.col("verdict") != "stationary")
    joined = verdicts.join(F.broadcast(shape), "series")  # one row per series
    return joined.select("series", "verdict", F.when(wide, F.concat(base, F.lit(" + log_transform"))).otherwise(base).alias("transform"))


def stationarity_table(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, verdict, transform) for every tested series. Runs the jobs of both tests."""
    sums = sequence_sums(seq, columns)
    return recommend_transform(seq, joint_verdict(adf_test(seq, sums=sums), kpss_test(seq, sums=sums)))
