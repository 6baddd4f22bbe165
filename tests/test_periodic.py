"""Exactly periodic and trending series through the unit-root, level and partial-autocorrelation operators, and the advice they lead to."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.functions.tails import partial_autocorrelations
from sondeo.operators import autocorrelation, profile, report, stationarity
from sondeo.plans.sequence import time_order


@pytest.fixture(scope="module")
def seq(spark):
    rng = np.random.default_rng(8)
    w = rng.normal(size=400)
    t = np.arange(400)
    columns = {"cycle": t % 7.0, "noise": w, "rising": 0.002 * t + w, "walk": np.cumsum(w), "alternating": (-1.0) ** t}
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=int(i)), *(float(v[i]) for v in columns.values())) for i in t]
    df = spark.createDataFrame(rows, "at timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))
    return time_order(df, F.col("at"), list(columns))


def test_partial_values_stay_within_one(seq):
    for r in autocorrelation.acf_and_pacf(seq).collect():
        assert r.pacf is None or np.isnan(r.pacf) or abs(r.pacf) <= 1, r
    for r in autocorrelation.arima_order_hint(seq).collect():
        assert r.p < 40


@pytest.mark.parametrize("r", [[1.0, 1.01, 1.02], [1.0, 0.9, 0.2, -0.9], [1.0, -1.0, 1.0, -1.0], [1.0, 0.0, 0.0]])
def test_no_value_beyond_one(r):
    out = partial_autocorrelations(r)
    assert len(out) == len(r) and all(np.isnan(x) or abs(x) <= 1 for x in out)
    ended = [np.isnan(x) for x in out]
    assert ended == sorted(ended)  # once there is none, there is none


def test_a_series_that_explains_itself_is_singular(seq):
    found = {r.series: r for r in stationarity.adf_test(seq).collect()}
    assert [found[c].reason for c in ("cycle", "alternating")] == ["singular"] * 2 and found["cycle"].statistic is None
    assert all(found[c].reason is None and found[c].statistic is not None for c in ("noise", "rising", "walk"))
    level = {r.series: r.stationary for r in stationarity.kpss_test(seq).collect()}
    assert level["cycle"] and level["noise"] and not level["rising"]


def test_advice_by_transform(spark, seq):
    table = stationarity.stationarity_table(seq)
    assert {r.series: (r.verdict, r["transform"]) for r in table.collect()}["rising"] == ("trend_stationary", "detrend")
    p = profile.build_profile(seq.table)
    p.dataset_type, p.numeric = "time_series", list(seq.columns)
    advice = lambda t: report.recommended_action(p, spark, {"stationarity_table": t}).first()["action"]
    assert advice(table) == "Model changes of walk, not levels; Take the trend out of rising before modelling"
    assert advice(table.where("series = 'rising'")) == "Take the trend out of rising before modelling"
    assert advice(table.where("series = 'walk'")) == "Model changes of walk, not levels"
    assert advice(table.where("series in ('noise', 'cycle')")) == "Run the report again on newer rows"
