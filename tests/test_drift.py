"""Drift against plain numpy: ties, hot values, one-sided and empty columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.operators.drift import category_drift, kolmogorov_tail, numeric_drift

SCHEMA = "now boolean, value double, side double"


def distance(a, b):
    at = np.concatenate([a, b])
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in at)


def stability(a, b, bins):
    place = lambda v: min(bins - 1, bins * int((a < v).sum()) // len(a))
    old, new = (np.bincount([place(v) for v in x], minlength=bins) for x in (a, b))
    p, q = np.maximum(old, 0.5) / max(len(a), bins / 2), np.maximum(new, 0.5) / max(len(b), bins / 2)
    return float(((q - p) * np.log(q / p))[old + new > 0].sum())


def framed(spark, a, b):
    return spark.createDataFrame([(now, float(v), 0.0) for now, x in ((False, a), (True, b)) for v in x], SCHEMA)


@pytest.mark.parametrize(("shape", "bins"), [("moved", 10), ("hot", 10), ("few", 4)])
def test_equals_a_loop(spark, shape, bins):
    rng = np.random.default_rng(5)
    a, b = {
        "moved": (rng.normal(size=300).round(2), rng.normal(0.4, 1.3, 200).round(2)),
        "hot": (np.where(rng.random(400) < 0.5, -0.0, rng.integers(-3, 9, 400)), np.where(rng.random(90) < 0.3, 0.0, rng.integers(-3, 9, 90))),
        "few": (np.array([1.0, 2.0, math.inf]), np.array([-math.inf, 2.0])),
    }[shape]
    found = {r["column"]: r for r in numeric_drift(framed(spark, a, b), F.col("now"), ["value", "side"], bins).collect()}
    r = found["value"]
    assert (r["n_reference"], r["n_current"]) == (len(a), len(b))
    assert r["ks"] == pytest.approx(distance(a, b)) and r["psi"] == pytest.approx(stability(a, b, bins))
    # a constant column has not moved
    assert (found["side"]["ks"], found["side"]["p_value"], found["side"]["psi"], found["side"]["shift"]) == (0.0, 1.0, 0.0, "stable")


def test_missing_values_sides_and_columns(spark):
    df = spark.createDataFrame([(False, 1.0, None), (True, math.nan, 2.0), (True, None, 3.0), (None, 9.0, 9.0), (False, 1.0, None)], SCHEMA)
    found = {r["column"]: r for r in numeric_drift(df, F.col("now"), ["value", "side"]).collect()}
    assert (found["value"]["n_reference"], found["value"]["n_current"], found["value"]["ks"], found["value"]["shift"]) == (2, 0, None, None)
    assert (found["side"]["n_reference"], found["side"]["n_current"], found["side"]["psi"], found["side"]["p_value"]) == (0, 2, None, None)
    assert numeric_drift(df, F.col("now"), []).count() == 0 and numeric_drift(df.limit(0), F.col("now"), ["value"]).count() == 0


def test_tail_values(spark):
    # known points of the limiting distribution: 1.3581 is its 95th percentile, 1.6276 its 99th
    rows = spark.createDataFrame([(1.3581, 0.05), (1.6276, 0.01), (0.5, 0.9639), (0.1, 1.0), (9.0, 0.0)], "scaled double, p double")
    size = F.lit(1e12)
    for r in rows.withColumn("found", kolmogorov_tail(F.col("scaled") / F.sqrt(size), size)).collect():
        assert r["found"] == pytest.approx(r["p"], abs=5e-5)


def test_categories(spark):
    rows = [(False, "a")] * 6 + [(False, "b")] * 2 + [(True, "a")] * 1 + [(True, "new")] * 3 + [(None, "a"), (True, None)]
    df = spark.createDataFrame(rows, "now boolean, kind string").withColumn("gone", F.when(~F.col("now"), "x"))
    found = {r["column"]: r for r in category_drift(df, F.col("now"), ["kind", "gone"]).collect()}
    kind = found["kind"]
    assert (kind["n_reference"], kind["n_current"], kind["n_categories"], kind["shift"]) == (8, 4, 3, "large")
    p, q = np.array([6, 2, 0.5]) / 8, np.array([1, 0.5, 3]) / 4
    assert kind["psi"] == pytest.approx(float(((q - p) * np.log(q / p)).sum()))
    assert kind["total_variation"] == pytest.approx((abs(6 / 8 - 1 / 4) + 2 / 8 + 3 / 4) / 2)
    assert (found["gone"]["n_current"], found["gone"]["psi"], found["gone"]["shift"]) == (0, None, None)
    assert category_drift(df.limit(0), F.col("now"), ["kind"]).count() == 0
