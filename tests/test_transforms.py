"""Transforms and their inverse across block borders, with gaps, logarithms and empty input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.operators.transforms import restored, transformed
from sondeo.plans.sequence import time_order

NAMES = {"a": "first_difference", "b": "seasonal_difference", "c": "detrend + log_transform", "d": "none", "e": "first_difference + log_transform"}


def ordered(spark, n, low=1.0):
    rng = np.random.default_rng(n)
    rows = [(i, *(float(v) for v in low + rng.random(5) * 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double")
    df = df.withColumn("a", F.when((F.col("k") % 9 != 0), F.col("a")))
    return time_order(df, F.timestamp_seconds("k"), list(NAMES), block_rows=6)


def column(frame, name, value):
    return [r[value] for r in frame.where(F.col("series") == name).orderBy("pos").collect()]


@pytest.mark.parametrize(("n", "season"), [(50, 4), (41, 11), (3, 5), (1, 1)])
def test_round_trip(spark, n, season):
    seq = ordered(spark, n)
    there = transformed(seq, NAMES, season)
    back = restored(there, NAMES, season, seq.block_rows)
    for name in NAMES:
        wanted = column(seq.series([name]), name, "y")
        assert column(back, name, "y") == pytest.approx(wanted, rel=1e-12)
        found = column(there, name, "value")
        if name == "b":
            assert found[season:] == pytest.approx(np.array(wanted[season:]) - wanted[: len(wanted[season:])]) and found[:season] == [None] * min(n, season)
        if name == "c" and n > 2:
            logs = np.log(wanted)
            assert found == pytest.approx(logs - np.polyval(np.polyfit(range(n), logs, 1), range(n)), abs=1e-9)


def test_no_logarithm_of_zero(spark):
    seq = ordered(spark, 20, low=-3.0)
    there = transformed(seq, {"e": "first_difference + log_transform"})
    assert set(column(there, "e", "value")) == {None}
    assert column(restored(there, {"e": "first_difference + log_transform"}, 7, 6), "e", "y") == [None] * 20


def test_rows_beyond_the_end_go_on(spark):
    seq = ordered(spark, 13)
    more = transformed(seq, {"b": "seasonal_difference"}, 3).unionByName(spark.createDataFrame([("b", i, 0.5, None) for i in range(13, 20)], "series string, pos bigint, value double, base double"))
    y = column(restored(more, {"b": "seasonal_difference"}, 3, 6), "b", "y")
    assert all(math.isclose(y[i], y[i - 3] + 0.5) for i in range(13, 20))


def test_nothing_and_unknown(spark):
    seq = ordered(spark, 5)
    assert transformed(seq, {}).count() == 0
    with pytest.raises(ValueError, match="twice"):
        transformed(seq, {"a": "twice"})
