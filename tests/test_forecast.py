"""Rolling-origin forecasts against a plain loop: block borders, gaps, zeros, panels and empty input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.operators.forecast import baseline_forecast, forecast_errors, rolling_origin
from sondeo.plans.panel import panel_order
from sondeo.plans.sequence import time_order

SCHEMA = "who string, at timestamp_ntz, k int, pos double"


def rows_of(who, values):
    # pairs of rows share a time
    return [(who, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 2), i, v) for i, v in enumerate(values)]


def ordered(spark, values, block_rows=8):
    df = spark.createDataFrame(rows_of("a", values), SCHEMA)
    return time_order(df, F.col("at"), ["pos"], [F.col("k")], block_rows=block_rows)


def at_origin(values, o, step, season, window, train_rows=None):
    """What each method says ``step`` rows after position ``o``."""
    y = np.array([np.nan if v is None else v for v in values[: o + 1]], float)
    t = np.arange(o + 1)
    there = ~np.isnan(y)
    naive = y[there][-1] if there.any() else None
    place = o + step - season * -(-step // season)
    seasonal = y[place] if place >= 0 and there[place] else None
    near = y[max(0, o - window + 1) :]
    mean = float(np.nanmean(near)) if (~np.isnan(near)).any() else None
    fit = there & (t > o - train_rows if train_rows else True)
    line = float(np.polyval(np.polyfit(t[fit], y[fit], 1), o + step)) if fit.sum() >= 2 else None
    return [naive, seasonal, mean, line]


def series(n, seed):
    rng = np.random.default_rng(seed)
    values = [float(v) for v in 1e6 + 0.3 * np.arange(n) + rng.normal(size=n)]
    for gap in (0, 1, *range(n // 2, n // 2 + 11), n - 1):  # longer than a block
        values[gap] = None
    return values


def same(found, wanted):
    for a, b in zip(found, wanted, strict=True):
        assert (a is None) == (b is None), (found, wanted)
        assert a is None or a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize(("horizon", "every", "first", "season", "window", "train_rows"), [(5, 3, 4, 2, 3, None), (9, 7, 0, 4, 12, 6), (1, 1, 1, 30, 1, 2)])
def test_origins_equal_a_loop(spark, horizon, every, first, season, window, train_rows):
    values = series(70, every)
    found = rolling_origin(ordered(spark, values), horizon, every, first, season, window, train_rows).collect()
    pairs = {(o, s) for o in range(first, 69, every) for s in range(1, horizon + 1) if o + s < 70 and values[o + s] is not None}
    assert {(r["origin"], r["step"]) for r in found} == pairs and len(found) == len(pairs)
    for r in found:
        assert r["pos"] == r["origin"] + r["step"] and r["actual"] == values[r["pos"]]
        same([r["naive"], r["seasonal_naive"], r["moving_average"], r["linear"]], at_origin(values, r["origin"], r["step"], season, window, train_rows))


@pytest.mark.parametrize("n", [3, 29])
def test_forecast_beyond_the_end(spark, n):
    values = [float(i * i % 13) for i in range(n)]
    values[n // 2] = None
    found = baseline_forecast(ordered(spark, values), 9, 4, 5).collect()
    assert sorted(r["step"] for r in found) == list(range(1, 10))
    for r in found:
        assert r["pos"] == n - 1 + r["step"]
        same([r["naive"], r["seasonal_naive"], r["moving_average"], r["linear"]], at_origin(values, n - 1, r["step"], 4, 5))


def test_entities_do_not_mix(spark):
    each = {"a": series(40, 1), "b": [5.0], None: [1.0, 2.0, 4.0, 8.0, 16.0], "c": [None, None, None, None]}
    df = spark.createDataFrame([r for who, v in each.items() for r in rows_of(who, v)], SCHEMA)
    panel = panel_order(df, ["who"], F.col("at"), ["pos"], [F.col("k")], block_rows=8, partitions=5)
    found = rolling_origin(panel, 2, 1, 2, 2, 3).collect()
    assert {r["who"] for r in found} == {"a", None} and {r["column"] for r in found} == {"pos"}
    for r in found:
        same([r["naive"], r["seasonal_naive"], r["moving_average"], r["linear"]], at_origin(each[r["who"]], r["origin"], r["step"], 2, 3))


def test_errors_with_zeros_and_missing_forecasts(spark):
    frame = spark.createDataFrame(
        [("s", 0.0, 1.0, None), ("s", 2.0, 1.0, 2.0), ("s", -4.0, -2.0, None), ("z", 0.0, 0.0, None)], "series string, actual double, naive double, linear double",
    )
    found = {(r["series"], r["method"]): r for r in forecast_errors(frame, methods=["naive", "linear"]).collect()}
    naive = found["s", "naive"]
    assert (naive["n"], naive["bias"], naive["mape"], naive["n_zero"]) == (3, pytest.approx(2 / 3), 50.0, 1)
    assert naive["mae"] == pytest.approx(4 / 3) and naive["rmse"] == pytest.approx(2**0.5)
    assert (found["s", "linear"]["n"], found["s", "linear"]["mae"]) == (1, 0.0)
    assert (found["z", "naive"]["mape"], found["z", "naive"]["n_zero"]) == (None, 1)
    assert (found["z", "linear"]["n"], found["z", "linear"]["rmse"]) == (0, None)


def test_short_empty_and_wrong_input(spark):
    assert rolling_origin(ordered(spark, [1.0]), 3).count() == 0
    empty = ordered(spark, [])
    assert rolling_origin(empty, 3).count() == 0 and baseline_forecast(empty, 3).count() == 0
    with pytest.raises(ValueError, match="horizon"):
        rolling_origin(empty, 0)
