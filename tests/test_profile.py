import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeo import sources
from sondeo.operators import profile


def column(spark, values, ddl):
    return spark.createDataFrame([(v,) for v in values], ddl)


def detected(df):
    row = profile.detect_date_column(df).first()
    return None if row is None else (row["column"], row["format"])


def test_kinds(spark):
    df = spark.createDataFrame([], "a int, b decimal(9,2), c string, d boolean, e date, f timestamp_ntz, g array<int>, h double")
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    assert kinds == {"a": "numeric", "b": "numeric", "c": "categorical", "d": "categorical", "e": "datetime",
                     "f": "datetime", "g": "unsupported", "h": "numeric"}


def test_nan_is_missing(spark):
    df = sources.normalize(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert profile.missing_profile(df).first()["missing_pct"] == pytest.approx(200 / 3)


@pytest.mark.parametrize("good,accepted", [(69, False), (70, True), (71, True)])
def test_date_share_limit(spark, good, accepted):
    values = [(dt.date(2024, 1, 1) + dt.timedelta(i)).isoformat() if i < good else "no date" for i in range(100)]
    assert (detected(column(spark, values, "d string")) == ("d", "iso_date")) is accepted


def test_earlier_candidate_wins_a_tie_and_higher_share_wins_over_a_name(spark):
    rows = [("2024-01-01", "2024-01-02", "x")] * 3
    assert detected(spark.createDataFrame(rows, "a string, b string, c string"))[0] == "a"
    rows = [("2024-01-01", "2024-01-02")] * 3 + [("x", "2024-01-02")]
    assert detected(spark.createDataFrame(rows, "start_date string, b string"))[0] == "b"


def test_one_format_per_column(spark):
    # month-first wins the tie, and a column of day-first dates is read day-first
    assert detected(column(spark, ["01/02/2024", "03/04/2024"], "d string"))[1] == "slash_mdy"
    assert detected(column(spark, ["13/02/2024", "23/04/2024"], "d string"))[1] == "slash_dmy"
    mixed = column(spark, ["2024-01-01", "01/02/2024"], "d string")
    assert detected(mixed) is None


@pytest.mark.parametrize("text,label,day", [
    ("5 Mar 2024", "day_name_month", dt.datetime(2024, 3, 5)), ("Mar 5, 2024", "month_day_year", dt.datetime(2024, 3, 5)),
    ("20240305", "compact", dt.datetime(2024, 3, 5)), ("2024/3/5", "slash_ymd", dt.datetime(2024, 3, 5)),
    ("2024-03-05 07:08:09", "iso_datetime", dt.datetime(2024, 3, 5, 7, 8, 9)), ("Mar 2024", "month_year", dt.datetime(2024, 3, 1)),
    ("2024-03", "iso_month", dt.datetime(2024, 3, 1)), ("5.3.2024", "dot_dmy", dt.datetime(2024, 3, 5)),
])
def test_formats(spark, text, label, day):
    df = column(spark, [text], "d string")
    assert detected(df) == ("d", label)
    assert df.select(profile.date_value(df, "d", label).alias("v")).first()["v"] == day


def test_integers_are_dates_only_in_date_form(spark):
    assert detected(column(spark, [2019, 2020], "year int")) == ("year", "yyyy")
    assert detected(column(spark, [20190101, 20200229], "day_id int")) == ("day_id", "yyyymmdd")
    assert detected(column(spark, [17, 250000], "lifetime_value int")) is None


@pytest.mark.parametrize("days,rows,expected", [
    (5, 5, "cross_sectional"), (6, 6, "time_series"), (6, 12, "panel"),
])
def test_dataset_type(spark, days, rows, expected):
    values = [dt.date(2024, 1, 1) + dt.timedelta(i % days) for i in range(rows)]
    p = profile.build_profile(column(spark, values, "date date"))
    assert p.dataset_type == expected


@pytest.mark.parametrize("distinct,expected", [(95, False), (96, True)])
def test_identifier_limit(spark, distinct, expected):
    rows = [(i % distinct, f"c{i % distinct}", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, code string, f double")
    p = profile.build_profile(df)
    assert (p.identifiers == ["code", "id"]) is expected  # texts are listed first
    assert "f" in p.numeric


def test_identifier_screen_counts_close_columns_exactly(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 19_001).alias("near"), (F.col("id") % 18_999).alias("under"))
    found = {r["column"]: r["is_identifier"] for r in profile.identifier_columns(df).collect()}
    assert found == {"id": True, "near": True, "under": False}


def test_distinct_counts_match_pandas(spark):
    pdf = pd.DataFrame({"a": ["x", "X", None, "y" * 200, "y" * 200], "b": [0.0, -0.0, 1.5, 1.5, None]})
    df = sources.normalize(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a string, b double"))
    got = {r["column"]: r["n_distinct"] for r in profile.distinct_counts(df, ["a", "b"]).collect()}
    assert got == {c: pdf[c].nunique() for c in pdf}


def test_empty_tables(spark):
    p = profile.build_profile(spark.createDataFrame([], "a string, b double"))
    assert p.rows == 0 and p.date_column is None and p.dataset_type == "cross_sectional"
    assert profile.missing_profile(spark.createDataFrame([], "a string")).count() == 0


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x,flag,when,s\n1,NA,True,2024-01-01,"a, ""b"""\n2,2.5,False,2024-01-02,null\n')
    df = sources.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "timestamp_ntz", "string"]
    rows = df.orderBy("id").collect()
    assert rows[0]["x"] is None and rows[1]["s"] is None and rows[0]["s"] == 'a, "b"'


def test_round_trip_of_results_and_formats(spark, tables, tmp_path):
    result = profile.shape(tables("nation"))
    sources.write_result(result, str(tmp_path / "out"))
    assert sources.read_parquet(spark, str(tmp_path / "out")).collect() == result.collect()
    result.write.json(str(tmp_path / "j"))
    result.write.orc(str(tmp_path / "o"))
    assert sources.read_json(spark, str(tmp_path / "j")).first()["rows"] == 25
    assert sources.read_orc(spark, str(tmp_path / "o")).first()["rows"] == 25
    assert sources.preview(tables("nation")).count() == 20
