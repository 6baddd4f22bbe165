"""Ordered sequences: positions, blocks, trend, seasonality, stationarity, autocorrelation."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeo.functions import tails
from sondeo.operators import autocorrelation as ac
from sondeo.operators import seasonality, stationarity, trend
from sondeo.plans.sequence import lag_products, time_order, with_lags

DAY = dt.timedelta(days=1)
START = dt.datetime(2020, 1, 1)


def sequence(spark, columns, step=DAY, **options):
    pdf = pd.DataFrame(columns)
    rows = [
        (START + step * i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(pdf.itertuples(index=False))
    ]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "t timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))
    return time_order(df, F.col("t"), list(columns), **options)


def values(frame, column, order="pos"):
    return [r[column] for r in frame.orderBy(order).collect()]


# block sizes below, at and above the halo; one and several partitions
LAYOUTS = [dict(), dict(block_rows=13, partitions=5), dict(block_rows=200, partitions=3)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_positions_follow_time_with_heavy_ties(spark, layout):
    # a third of all rows share one date
    rows = [(START + DAY * (50 if i % 3 == 0 else i % 100), float(i)) for i in range(600)] + [(None, -1.0)] * 5
    df = spark.createDataFrame(rows, "t timestamp_ntz, y double")
    seq = time_order(df, F.col("t"), ["y"], [F.col("y")], **layout)
    got = seq.table.orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(600)) and seq.dropped_null_dates == 5
    assert [r["y"] for r in got] == [y for _, y in sorted(r for r in rows if r[0])]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("seed", range(2))
def test_gap_filling_matches_pandas(spark, layout, seed):
    rng = np.random.default_rng(seed)
    y = pd.Series(rng.normal(size=300))
    y[rng.random(300) < 0.4] = np.nan
    y[:20] = y[100:190] = y[-7:] = np.nan  # gaps longer than a block, and both ends
    seq = sequence(spark, {"y": y, "whole": 1.0, "none": np.nan}, **layout)
    want = y.interpolate(limit_direction="both")
    assert values(seq.series(["y", "none"]), "y") == pytest.approx(want.tolist())
    assert seq.present == {"y": int(y.count()), "whole": 300, "none": 0}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_lags_rolling_and_lag_products(spark, layout):
    y = pd.Series(np.random.default_rng(2).normal(size=301))
    seq = sequence(spark, {"y": y}, **layout)
    lagged = with_lags(seq.series(["y"]), [1, 12], seq.block_rows).orderBy("pos").toPandas()
    for k in (1, 12):
        assert np.allclose(lagged[f"lag_{k}"], y.shift(k), equal_nan=True)
    rolled = values(trend.rolling_mean(seq, 7, ["y"]), "rolling_mean")
    assert rolled == pytest.approx(y.rolling(7, min_periods=1).mean().tolist())
    sums = {(r["kind"], r["lag"]): r["total"] for r in lag_products(seq.series(["y"]), 30, seq.block_rows, True).collect()}
    v, d = y.to_numpy(), np.diff(y, prepend=y[0])
    for k in range(31):
        assert sums[("yy", k)] == pytest.approx(v[k:] @ v[: 301 - k])
        assert sums[("dd", k)] == pytest.approx(d[k:] @ d[: 301 - k])
        assert sums[("yd", k)] == pytest.approx(v[k:] @ d[: 301 - k])
    assert sums[("y", 0)] == pytest.approx(v.sum())


@pytest.mark.parametrize("step,window", [(DAY / 480, 7), (DAY, 7), (DAY * 7, 4), (DAY * 30, 3)])
def test_rolling_window_from_gap(spark, step, window):
    assert trend.infer_rolling_window(sequence(spark, {"y": np.arange(20.0)}, step)).first()["rolling_window"] == window


def test_rolling_window_without_gaps(spark):
    assert trend.infer_rolling_window(sequence(spark, {"y": [1.0]})).first()["rolling_window"] == 7


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(4)
    t = np.arange(365)
    return sequence(spark, {
        "up": 50 + 0.5 * t + rng.normal(size=365), "down": 500 - 0.5 * t + rng.normal(size=365), "flat": np.full(365, 3.0),
        "noise": 100 + rng.normal(size=365), "jump": np.where(t < 182, 0.0, 5.0) + rng.normal(size=365),
    })


def test_directions_and_breaks(daily):
    rows = {r["column"]: r for r in trend.trend_table(daily, daily.columns).collect()}
    assert {c: r["direction"] for c, r in rows.items()} == {
        "up": "upward", "down": "downward", "flat": "stable", "noise": "stable", "jump": rows["jump"]["direction"]}
    assert rows["jump"]["structural_break"] and not rows["noise"]["structural_break"] and not rows["flat"]["structural_break"]
    flat = rows["flat"]
    assert (flat["slope"], flat["r2"], flat["p_value"]) == (0.0, 0.0, 1.0)
    assert [r["series"] for r in trend.break_marker(daily, ["jump", "noise"]).collect()] == ["jump"]
    assert trend.trend_columns(daily, 2) == ["down", "up"] or trend.trend_columns(daily, 2) == ["up", "down"]


def test_line_matches_least_squares(daily):
    y = np.array(values(daily.series(["up"]), "y"))
    slope, intercept = np.polyfit(np.arange(365), y, 1)
    row = trend.ols_trend(daily, ["up"]).first()
    assert (row["slope"], row["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    assert values(trend.ols_fitted_line(daily, ["up"]), "fitted")[-1] == pytest.approx(intercept + slope * 364)


def test_perfect_line_and_zero_start(spark):
    row = trend.trend_table(sequence(spark, {"y": np.arange(10.0)})).first()
    assert row["start"] == 1e-9 and row["p_value"] == 0.0 and row["direction"] == "upward"


@pytest.mark.parametrize("n,rows", [(3, 0), (4, 1)])
def test_trend_needs_four_rows(spark, n, rows):
    assert trend.trend_table(sequence(spark, {"y": np.arange(float(n))})).count() == rows


def test_seasonal_classes(spark):
    rng = np.random.default_rng(6)
    wave = np.sin(2 * np.pi * np.arange(420) / 7)
    seq = sequence(spark, {"cycle": wave, "weak": 0.75 * wave + rng.normal(size=420), "noise": rng.normal(size=420), "flat": np.ones(420)})
    got = {r["series"]: r["seasonal_class"] for r in seasonality.seasonal_class(seq).collect()}
    assert got == {"cycle": "seasonal", "weak": "weakly_seasonal", "noise": "not_seasonal", "flat": "not_seasonal"}
    for r in seasonality.lag_correlation(seq, ["weak"]).collect():
        y = pd.Series(values(seq.series(["weak"]), "y"))
        assert r["r"] == pytest.approx(y.autocorr(r["lag"]))
    assert {r["series"] for r in seasonality.calendar_box_stats(seq).collect()} == {"cycle", "weak"}
    short = sequence(spark, {"y": np.arange(5.0)})
    assert {r["r"] for r in seasonality.lag_correlation(short).collect()} == {0.0}


def test_calendar_means(spark):
    y = np.arange(400.0)
    seq = sequence(spark, {"y": y})
    s = pd.Series(y, index=pd.date_range(START, periods=400))
    months = {r["period"]: r["mean"] for r in seasonality.month_means(seq).collect()}
    days = {r["period"]: r["mean"] for r in seasonality.weekday_means(seq).collect()}
    assert months == pytest.approx(s.groupby(s.index.month).mean().to_dict())
    assert days == pytest.approx(s.groupby(s.index.dayofweek).mean().to_dict())


def direct_adf(y, m):
    """Least squares lag by lag, straight from the definition."""
    d = np.diff(y)

    def fit(p, first):
        t = np.arange(first + 1, len(y))
        x = np.array([np.ones(len(t)), y[t - 1], *[d[t - j - 1] for j in range(1, p + 1)]]).T
        beta = np.linalg.lstsq(x, d[t - 1], rcond=None)[0]
        return x, beta, ((d[t - 1] - x @ beta) ** 2).sum()

    scores = []
    for p in range(m + 1):
        x, _, rss = fit(p, m)
        scores.append(len(x) * np.log(rss / len(x)) + 2 * (p + 2))
    p = int(np.argmin(scores))
    x, beta, rss = fit(p, p)
    return beta[1] / np.sqrt(rss / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), p


def direct_kpss(y, lags):
    e = y - y.mean()
    n = len(e)
    long_run = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / long_run


@pytest.mark.parametrize("layout", [dict(), dict(block_rows=37, partitions=3)])
def test_stationarity_against_direct_computation(spark, layout):
    w, t = np.random.default_rng(8).normal(size=400), np.arange(400)
    cases = {"noise": w, "walk": np.cumsum(w), "line": 0.01 * t + w, "weak": 0.002 * t + w, "far": 1e6 + w}
    seq = sequence(spark, cases, **layout)
    for r in stationarity.adf_test(seq).collect():
        y = cases[r["series"]]
        tau, p = direct_adf(y - y.mean(), stationarity.max_adf_lag(400))
        assert (r["statistic"], r["lags"]) == (pytest.approx(tau, rel=1e-6), p)
    for r in stationarity.kpss_test(seq).collect():
        assert r["statistic"] == pytest.approx(direct_kpss(cases[r["series"]], r["lags"]))
    got = {r["series"]: (r["verdict"], r["transform"]) for r in stationarity.stationarity_table(seq).collect()}
    assert got == {"noise": ("stationary", "none"), "walk": ("unit_root", "first_difference"), "line": ("unit_root", "first_difference"),
                   "weak": ("trend_stationary", "detrend"), "far": ("stationary", "none")}


def test_short_walk_is_difference_stationary_and_constants_get_a_reason(spark):
    w = np.random.default_rng(8).normal(size=400)
    seq = sequence(spark, {"y": np.cumsum(w[:20]), "flat": np.ones(20)})
    assert {r["series"]: r["verdict"] for r in stationarity.stationarity_table(seq).collect()} == {"y": "difference_stationary", "flat": None}
    assert {r["series"]: r["reason"] for r in stationarity.adf_test(seq).collect()} == {"y": None, "flat": "constant"}


@pytest.mark.parametrize("n,tested", [(9, 0), (10, 1)])
def test_stationarity_needs_ten_rows(spark, n, tested):
    seq = sequence(spark, {"y": np.random.default_rng(0).normal(size=n)})
    assert stationarity.adf_test(seq).count() == stationarity.kpss_test(seq).count() == tested


def test_wide_bandwidth_takes_a_second_pass(spark):
    y = np.cumsum(np.cumsum(np.random.default_rng(1).normal(size=3000)))
    row = stationarity.kpss_test(sequence(spark, {"y": y}, block_rows=500)).first()
    assert row["lags"] > max(stationarity.max_adf_lag(3000), stationarity.kpss_start(3000))
    assert row["statistic"] == pytest.approx(direct_kpss(y, row["lags"]))


def test_critical_values():
    assert tails.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-5)
    assert tails.f_upper(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-5)
    assert tails.unit_root_p(-2.862) == pytest.approx(0.0499, abs=1e-4)
    assert tails.unit_root_p(-3.430) == pytest.approx(0.00997, abs=1e-4)
    assert [tails.level_p(x) for x in (0.1, 0.463, 9.0)] == pytest.approx([0.10, 0.05, 0.01])


def test_acf_pacf_and_order_hint(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=2000)
    ar = np.zeros(2000)
    for i in range(1, 2000):
        ar[i] = 0.7 * ar[i - 1] + e[i]
    ma = e + 0.8 * np.roll(e, 1)
    seq = sequence(spark, {"ar": ar, "ma": ma, "flat": np.ones(2000)}, block_rows=300)
    table = seq.table.sparkSession.createDataFrame(ac.correlogram(seq).collect())
    for name, y in (("ar", ar), ("ma", ma)):
        d = y - y.mean()
        rows = {r["lag"]: r for r in table.where(F.col("series") == name).collect()}
        assert len(rows) == 41
        for k in range(41):
            assert rows[k]["acf"] == pytest.approx((d[k:] @ d[: 2000 - k]) / (d @ d))
        r = [rows[k]["acf"] * 2000 / (2000 - k) for k in range(6)]
        toeplitz = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)])
        assert rows[5]["pacf"] == pytest.approx(np.linalg.solve(toeplitz, r[1:])[-1])
        assert rows[1]["pacf"] == pytest.approx(rows[1]["acf"] * 2000 / 1999)
    hints = {r["series"]: (r["p"], r["q"]) for r in ac.arima_order_hint(seq, lags=table).collect()}
    assert hints["ar"][0] == 1 and hints["ma"][1] == 1 and hints["flat"] == (0, 0)
    assert ac.significant_lags(seq, ["flat"]).count() == 0


@pytest.mark.parametrize("n,rows", [(14, 0), (15, 7)])
def test_acf_needs_fifteen_rows(spark, n, rows):
    assert ac.acf(sequence(spark, {"y": np.random.default_rng(0).normal(size=n)})).count() == rows


def test_lag_pairs_and_band(daily):
    pairs = ac.lag_pairs(daily, ["up"]).orderBy("pos").collect()
    y = values(daily.series(["up"]), "y")
    assert [r["y"] for r in pairs] == y[1:] and [r["y_lag1"] for r in pairs] == y[:-1]
    assert ac.confidence_band(daily).first()["band"] == pytest.approx(1.96 / 365**0.5)
