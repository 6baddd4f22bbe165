import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeo.operators import eda, pipeline, report, segments
from sondeo.operators.profile import Profile
from sondeo.plans import scratch


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "two": rng.choice(["x", "y"], 600), "twenty": [f"g{i % 20}" for i in range(600)], "more": [f"h{i % 21}" for i in range(600)],
        "one": "same", "y": rng.normal(size=600), "z": rng.gamma(2, size=600),
    })
    pdf.loc[pdf.two == "x", "y"] += 2.0
    rows = [tuple(None if (c == "two" and i % 50 == 0) else v for c, v in zip(pdf, r)) for i, r in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "two string, twenty string, more string, one string, y double, z double")
    pdf.loc[pdf.index % 50 == 0, "two"] = None
    return df, pdf


def test_usable_columns(people):
    got = [(r["column"], r["n_distinct"]) for r in segments.usable_segments(people[0]).collect()]
    assert got == [("two", 2), ("twenty", 20)]


def test_statistics_match_pandas(people):
    df, pdf = people
    rows = segments.segment_stats(df, ["two", "twenty"], ["y", "z"]).collect()
    assert len(rows) == 2 * (2 + 20)
    for r in rows:
        x = pdf[pdf[r["cat_col"]] == r["cat"]][r["num_col"]]
        assert (r["n"], r["mean"], r["std"], r["median"]) == (
            len(x), pytest.approx(x.mean()), pytest.approx(x.std()), pytest.approx(x.median()))


def test_anova_and_best_grouping(people):
    df, pdf = people
    rows = {(r["cat_col"], r["num_col"]): r for r in segments.anova(df, ["twenty", "two"], ["y", "z"]).collect()}
    a, b = (pdf[pdf.two == v].y for v in ("x", "y"))
    n, grand = len(a) + len(b), pd.concat([a, b]).mean()
    ssb = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    ssw = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert rows[("two", "y")]["f_stat"] == pytest.approx(ssb / (ssw / (n - 2)))
    assert rows[("two", "y")]["p_value"] < 1e-6 and rows[("twenty", "z")]["p_value"] > 0.001
    assert segments.top_grouping(df, ["twenty", "two"], ["y", "z"]).first()["top_grouping"] == "two"


def test_degenerate_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.1), ("a", 0.1), ("b", 0.7), ("b", 0.7), ("c", 9.0)], "g string, y double")
    row = segments.anova(df.repartition(4), ["g"], ["y"]).first()
    assert row["degenerate"] and row["f_stat"] is None and row["df1"] == 1
    assert segments.top_grouping(df, ["g"], ["y"]).count() == 0


def test_top_and_bottom(people):
    df, pdf = people
    rows = segments.top_bottom_segments(df, "twenty", "z").collect()
    means = pdf.groupby("twenty").z.mean().sort_values(ascending=False)
    top = [r["cat"] for r in sorted((r for r in rows if r["side"] == "top"), key=lambda r: r["place"])]
    low = [r["cat"] for r in sorted((r for r in rows if r["side"] == "bottom"), key=lambda r: r["place"])]
    assert top == means.index[:5].tolist() and low == means.index[::-1][:5].tolist()
    assert {r["cat"]: r["mean"] for r in segments.segment_mean_bars(df, "two", "y").collect()} == pytest.approx(pdf.groupby("two").y.mean().to_dict())


def trends(spark, rows):
    return spark.createDataFrame(rows, "column string, pct_change double, p_value double, direction string, structural_break boolean, ordinal int")


def test_trend_statements(spark):
    t = trends(spark, [("a", 30.0, 0.01, "upward", False, 1), ("b", -30.0, 0.01, "downward", True, 2), ("c", 1.0, 0.01, "stable", False, 3),
                       ("d", 90.0, 0.2, "stable", False, 4)])
    text = {r["column"]: r["statement"] for r in report.trend_statements(t).collect()}
    assert text["a"] == "a: up 30.0%" and text["b"] == "b: down 30.0%" and "stable" in text["c"]
    assert "within chance" in text["d"]


@pytest.mark.parametrize("r,words", [(0.9, "strongly positive"), (-0.7, "strongly negative"), (0.5, "moderately positive"), (-0.1, "weakly negative")])
def test_relationship_words(spark, r, words):
    pairs = spark.createDataFrame([("a", "b", 0, 1, r)], "a string, b string, ordinal_a int, ordinal_b int, r double")
    assert words in report.relationship_statements(pairs).first()["statement"]


@pytest.mark.parametrize("r,text", [(0.845, "0.84"), (0.705, "0.70"), (-0.965, "-0.96"), (0.125, "0.12"), (0.375, "0.38"), (-0.715, "-0.71")])
def test_relationship_numbers_by_their_exact_value(spark, r, text):
    # 0.845 is a little less than it says: half up of its digits would give 0.85
    pairs = spark.createDataFrame([("a", "b", 0, 1, r)], "a string, b string, ordinal_a int, ordinal_b int, r double")
    assert report.relationship_statements(pairs).first()["statement"].endswith(f", r {text}")


def test_relationship_keeps_the_sign_of_a_small_r(spark):
    x = np.tile([-1.0, 1.0], 5000)
    y = np.where(np.arange(10000) % 4 < 2, 1.0, -1.0)
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "up": y + 2e-4 * x, "down": y - 2e-4 * x}))
    text = {r["b"]: r["statement"] for r in report.relationship_statements(eda.top_correlations(frame)).collect() if r["a"] == "x"}
    assert text == {"up": "x ~ up: weakly negative, r 0.00", "down": "x ~ down: weakly negative, r -0.00"}


def test_action_order(spark):
    p = Profile(columns=["t", "a", "b"], kinds={}, numeric=["a", "b"], dataset_type="time_series")
    falling = trends(spark, [("a", -30.0, 0.01, "downward", False, 1)])
    # as the stationarity table gives them
    still = spark.createDataFrame([("a", "unit_root", "first_difference"), ("b", "stationary", "none")], "series string, verdict string, transform string")
    leaning = spark.createDataFrame([("b", "trend_stationary", "detrend + log_transform")], still.schema)
    calm = still.where("verdict = 'stationary'")
    act = lambda tables: report.recommended_action(p, spark, tables).first()["action"]
    assert act({"stationarity_table": still, "trend_table": falling})== "Model changes of a, not levels"
    assert act({"stationarity_table": still.unionByName(leaning)}) == "Model changes of a, not levels; Take the trend out of b before modelling"
    assert act({"stationarity_table": calm, "trend_table": falling}) == "Find what makes a fall"
    assert act({"stationarity_table": calm, "trend_table": falling.limit(0)}).startswith("Run the report again")
    p.dataset_type = "cross_sectional"
    level = spark.createDataFrame([("strong",)], "level string")
    assert act({"correlation_warnings": level}).startswith("Have someone") and act({}).startswith("Start from the groups")


def test_stable_trend_is_not_called_a_decline(spark):
    p = Profile(columns=["a"], kinds={}, rows=10, numeric=["a"])
    t = trends(spark, [("a", 50.0, 0.5, "stable", False, 1)])
    messages = [r["message"] for r in report.business_findings(p, spark, {"trend_table": t}).orderBy("ord").collect()]
    assert "Largest change: none clear, a is stable" in messages


def test_routed_runs(spark, tables):
    events = pipeline.analyze(tables("events"))
    assert events.profile.dataset_type == "time_series" and events.profile.date_column == "ts"
    assert all(ok for _, ok, _ in events.status)
    assert {"trend_table", "seasonal_class", "stationarity_table", "correlogram"} <= set(events.results)
    assert events.text().startswith("1,000 records of 6 fields")
    segmented = pipeline.analyze(tables("customer"))
    assert segmented.profile.dataset_type == "cross_sectional" and "segment_stats" in segmented.results
    assert "trend_table" not in segmented.results


def test_failing_check_is_recorded_and_the_run_goes_on(spark, tables):
    def broken(df, profile):
        raise ValueError("no such thing")

    pipeline.register_check("broken", broken)
    pipeline.register_check("rows", lambda df, profile: df.agg(F.count(F.lit(1)).alias("n")))
    try:
        out = pipeline.analyze(tables("nation"))
    finally:
        pipeline.unregister_check("broken")
        pipeline.unregister_check("rows")
    status = {r["stage"]: (r["ok"], r["error"]) for r in out.stage_status(spark).collect()}
    assert status["broken"] == (False, "no such thing") and status["findings"][0] and out.results["rows"].first()["n"] == 25
    assert "broken" not in out.results


def test_scratch_uses_the_shared_folder(spark, tmp_path):
    before = scratch.scratch_folder(spark)
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.conf.isModifiable("spark.checkpoint.dir"):
        assert scratch.scratch_folder(spark) == str(tmp_path)
        spark.conf.unset("spark.checkpoint.dir")
    assert scratch.scratch_folder(spark) == before
