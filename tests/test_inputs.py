"""Inputs as users have them: odd dates, long numbers, broken lines, NaN, maps, many columns, equal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo import sources
from sondeo.operators import eda, pipeline, profile, quality, segments, stationarity, trend
from sondeo.operators import autocorrelation as ac
from sondeo.plans.ranks import with_ranks
from sondeo.plans.sequence import time_order

DATES = {
    "iso_zone": ["2024-01-0%dT00:00:00Z", "2024-01-0%dT10:30:00+02:00", "2024-01-0%d 10:30:00.25 -05:00"],
    "slash_mdy_half_day": ["1/%d/2024 3:30 PM"], "slash_mdy_half_day_seconds": ["1/%d/2024 3:30:09 AM"], "iso_half_day": ["2024-01-0%d 3:30 PM"],
    "dash_dmy_time": ["0%d-01-2024 13:30"], "day_full_month_year": ["%d January 2024"], "full_month_day_year": ["January %d, 2024"], "full_month_year": ["January 200%d"],
}


@pytest.mark.parametrize("label, form", [(k, f) for k, fs in DATES.items() for f in fs])
def test_dates_users_have(spark, label, form):
    df = spark.createDataFrame([(form % d, float(d)) for d in range(1, 9)], "stamp string, y double")
    found = profile.detect_date_column(df).first()
    assert found is not None and (found["column"], found["format"], found["share"]) == ("stamp", label, 1.0)
    values = [r[0] for r in df.select(profile.date_value(df, "stamp", label)).collect()]
    assert values == sorted(values) and len(set(values)) == 8


def test_zone_becomes_the_utc_clock(spark):
    df = spark.createDataFrame([("2024-01-01T10:30:00+02:00",), ("2024-01-01T10:30:00Z",)], "stamp string")
    got = [r[0] for r in df.select(profile.date_value(df, "stamp", "iso_zone")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 8, 30), dt.datetime(2024, 1, 1, 10, 30)]


def csv(tmp_path, text):
    (tmp_path / "in.csv").write_text(text)
    return str(tmp_path / "in.csv")


def test_whole_numbers_are_never_rounded(spark, tmp_path):
    rows = [(9_223_372_036_854_775_000 + i, 10**25 + i, 10**45 + i) for i in range(6)]
    path = csv(tmp_path, "a,b,c,d\n" + "".join(f"{a},{b},{c},{i}.5\n" for i, (a, b, c) in enumerate(rows)))
    df = sources.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "decimal(38,0)", "string", "double"]
    assert sorted((r.a, int(r.b), int(r.c)) for r in df.collect()) == rows


def test_line_breaks_in_quotes(spark, tmp_path):
    path = csv(tmp_path, 'id,note,at\n1,"two\nlines, ""quoted""",2024-01-01T00:00:00Z\n2,plain,2024-01-02T00:00:00+01:00\n')
    rows = sources.read_csv(spark, path, multi_line=True).orderBy("id").collect()
    assert [(r.id, r.note, r.at) for r in rows] == [(1, 'two\nlines, "quoted"', dt.datetime(2024, 1, 1)), (2, "plain", dt.datetime(2024, 1, 1, 23))]
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_csv(spark, path).collect()


def test_bad_values_are_counted(spark, tmp_path):
    path = csv(tmp_path, "a,b\n1,x\ntwo,y\nNA,z\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert [tuple(r) for r in sources.bad_values(spark, path, schema).collect()] == [("a", 1)]


def test_nan_is_missing_for_the_whole_run(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i % 3 == 0 else float(i % 7), "ab"[i % 2]) for i in range(60)], "x double, y double, g string")
    out = pipeline.analyze(df)
    assert all(ok for _, ok, _ in out.status), out.status
    assert {r["column"]: r["missing_pct"] for r in out.results["missing_profile"].collect()} == {"y": pytest.approx(100 / 3)}
    assert {"describe", "most_skewed", "histogram", "kpis", "relationship_statements", "segment_mean_bars"} <= set(out.results)


def test_maps_count_in_duplicates(spark):
    df = spark.sql("SELECT 1 AS a, map('k', 1, 'l', 2) AS m, array(map('x', 1)) AS n UNION ALL SELECT 1, map('l', 2, 'k', 1), array(map('x', 1)) UNION ALL SELECT 1, map('k', 2), array(map('x', 1)) UNION ALL SELECT 1, map('k', 2), array(map('x', 2))")
    assert quality.duplicate_rows(df).first()["duplicate_rows"] == 1
    assert quality.duplicate_rows(df.drop("n")).first()["duplicate_rows"] == 2


def test_long_spellings_come_back_whole(spark):
    long = "Word " * 30
    df = spark.createDataFrame([(long,), (long.upper(),), (long,), ("x",)], "s string")
    rows = {r.value: (r.folded, r.n) for r in quality.case_variants(df, ["s"]).collect()}
    assert rows == {long: (long.lower(), 2), long.upper(): (long.lower(), 1)}
    assert {r.value: r.n for r in profile.value_counts(df, ["s"]).collect()} == {long: 2, long.upper(): 1, "x": 1}


def test_no_operator_cuts_columns(spark):
    names = [f"m{i}" for i in range(17)]
    df = spark.range(120).select(
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id AS int))").alias("when"), *[F.chr((F.col("id") % (i + 2) + 65)).alias(f"g{i}") for i in range(7)],
        *[((F.col("id") * (i + 3) * 7919) % 1009).cast("double").alias(c) for i, c in enumerate(names)],
    )
    assert eda.mutual_information(df, names, top=None).count() == 17 * 16 // 2
    assert {r["column"] for r in eda.histogram(df, names).collect()} == set(names)
    groupings = [f"g{i}" for i in range(7)]
    assert segments.segment_names(df, groupings) == groupings and segments.segment_names(df, groupings, limit=2) == groupings[:2]
    assert {r["num_col"] for r in segments.segment_stats(df, groupings[:1], names[:8]).collect()} == set(names[:8])
    assert segments.anova(df, groupings, names).count() == 7 * 17
    seq = time_order(df, F.col("when"), names[:12])
    assert {r["series"] for r in stationarity.stationarity_table(seq).collect()} == set(names[:12])
    assert {r["series"] for r in ac.acf(seq, max_lags=3).collect()} == set(names[:12]) and ac.confidence_band(seq, names[:2]).count() == 2
    assert trend.trend_table(seq, top=None).count() == 12 and trend.trend_table(seq).count() == 5


def test_measures_called_like_the_position(spark):
    df = spark.range(40).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id AS int))").alias("d"), (F.col("id") * 2.0).alias("pos"), (F.col("id") * -1.0).alias("ts"))
    rows = {r["column"]: r["direction"] for r in trend.trend_table(time_order(df, F.col("d"), ["pos", "ts"])).collect()}
    assert set(rows) == {"pos", "ts"} and len(set(rows.values())) <= 2


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 1000, "a double, b double").repartition(4)
    ranked, n = with_ranks(df, ["a", "b"])
    assert n == 1000 and {(r.a, r.b) for r in ranked.collect()} == {(500.5, 500.5)}
    seq = time_order(df.select(F.lit("2024-01-01").cast("timestamp_ntz").alias("d"), "a"), F.col("d"), ["a"], partitions=4)
    sizes = [r["count"] for r in seq.table.groupBy(F.spark_partition_id()).count().collect()]
    assert seq.n == 1000 and len(sizes) >= 1 and sorted(r.pos for r in seq.table.collect()) == list(range(1000))


def test_partial_values_end_where_nothing_is_left_to_explain():
    import math

    from sondeo.functions.tails import partial_autocorrelations

    values = partial_autocorrelations([math.cos(2 * math.pi * k / 7) for k in range(12)])  # one wave: two values explain it
    assert values[:2] == [1.0, pytest.approx(math.cos(2 * math.pi / 7))] and values[2] == pytest.approx(-1.0)
    assert all(math.isnan(v) for v in values[3:])


def test_release_spares_other_runs(spark):
    import os

    from sondeo.plans import scratch

    first = scratch.stored(spark.range(3), "first")
    point = scratch.mark()
    second = scratch.stored(spark.range(4), "second")
    path = second.inputFiles()[0].removeprefix("file:")
    scratch.release(spark, point)
    assert not os.path.exists(path.removeprefix("//")) and first.count() == 3
