"""Windowed profiles of a stream: late rows, restarts, gaps and empty input."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sondeo.streaming.windows import WindowedProfile, window_profile

SCHEMA = "`when` timestamp_ntz, at double, span string"
DAY = dt.datetime(2024, 3, 1)


def hour(h, minute=0):
    return DAY + dt.timedelta(hours=h, minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """A folder that takes parts of rows, and an hourly profile with half an hour of patience."""
    kept = WindowedProfile(f"{tmp_path}/kept", "when", ["at", "span"], width=3_600, lateness=1_800)

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        kept.advance(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        return kept

    return arrive


def states(kept, spark):
    return {r["window_start"]: (r["state"], r["arrived"], r["kept"], r["late"]) for r in kept.arrivals(spark).collect()}


def test_late_rows_are_counted_and_left_out(spark, stream):
    stream([(hour(0, 5), 1.0, "a"), (hour(0, 50), 3.0, "a"), (hour(1, 40), 5.0, "b")])  # the mark is 1:10
    kept = stream([(hour(0, 10), 100.0, "late"), (hour(1, 5), 7.0, "b"), (None, 1.0, "x"), (hour(3), 1.0, "c")])
    assert states(kept, spark) == {
        hour(0): ("closed", 3, 2, 1), hour(1): ("closed", 2, 2, 0), hour(3): ("open", 1, None, 0), None: ("undated", 1, None, 0),
    }
    means = {r["window_start"]: r["mean"] for r in kept.profile(spark).where("column = 'at'").collect()}
    assert means == {hour(0): 2.0, hour(1): 6.0}


def test_a_window_of_late_rows_only(spark, stream):
    stream([(hour(5), 1.0, "a")])
    kept = stream([(hour(0), 1.0, "a"), (hour(0), 1.0, "a")])
    assert states(kept, spark)[hour(0)] == ("closed", 2, 0, 2)


def test_gaps_constants_and_repeated_rows(spark, stream):
    kept = stream([(hour(0), math.nan, "a"), (hour(0), None, "a"), (hour(0), 4.0, "a"), (hour(0), 4.0, "a"), (hour(1), None, None), (hour(9), 0.0, "z")])
    found = {(r["window_start"], r["column"]): r for r in kept.profile(spark).collect()}
    first = found[hour(0), "at"]
    assert (first["missing"], first["missing_pct"], first["high_missing"], first["constant"], first["std"]) == (2, 50.0, True, False, 0.0)
    assert (found[hour(0), "span"]["missing"], found[hour(0), "span"]["constant"], found[hour(0), "span"]["mean"]) == (0, True, None)
    assert (found[hour(1), "at"]["constant"], found[hour(1), "at"]["mean"]) == (True, None)


def test_nothing_new_changes_nothing(spark, stream):
    stream([(hour(0), 1.0, "a"), (hour(4), 1.0, "a")])
    before = states(stream([]), spark)
    assert before == {hour(0): ("closed", 1, 1, 0), hour(4): ("open", 1, None, 0)}


def test_empty_stream(spark, stream):
    kept = stream([])
    assert kept.profile(spark).count() == 0 and kept.arrivals(spark).count() == 0


def test_same_windows_on_a_table(spark, stream):
    rows = [(hour(i // 7, i % 60), float(i * i % 11), "ab"[i % 2]) for i in range(60)] + [(hour(40), 0.0, "a")]
    kept = stream(rows)
    whole = window_profile(spark.createDataFrame(rows, SCHEMA), F.col("when"), ["at", "span"], 3_600, 1_800).where(F.col("window_start") < hour(39))
    plain = lambda df: sorted(map(str, df.select("window_start", "column", "n_rows", F.round("mean", 9), F.round("skewness", 9)).collect()))
    assert plain(kept.profile(spark)) == plain(whole)
