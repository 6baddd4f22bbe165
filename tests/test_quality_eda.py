import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeo.operators import causal, eda, quality, segments
from sondeo.plans import quantiles, ranks
from sondeo.plans.quantiles import exact_quantiles


def test_duplicates_equal_only_through_nulls(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (None, None), (None, None), (1, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    assert quality.duplicate_rows(df).first()["duplicate_rows"] == 3
    # NULLs in different places share a hash but are different rows
    swapped = spark.createDataFrame([("x", None), (None, "x")], "a string, b string")
    assert quality.duplicate_rows(swapped).first().asDict() == {"rows": 2, "duplicate_rows": 0}
    assert quality.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0


def test_narrow_duplicates(spark):
    df = spark.range(10).select((F.col("id") % 4).alias("k"))
    assert quality.duplicate_rows(df).first().asDict() == {"rows": 10, "duplicate_rows": 6}


@pytest.mark.parametrize("hot_rows", [1, 4, 4096])
def test_repeated_rows_hot_and_rare(spark, monkeypatch, hot_rows):
    """A row that holds a third of the table, rare repeats, nulls and a column named like the hash."""
    monkeypatch.setattr(quality, "HOT_ROWS", hot_rows)
    rows = [("hot", 1, "x" * 50)] * 30 + [(f"r{i % 20}", None, "y" * 50) for i in range(50)] + [(None, i, None) for i in range(10)]
    df = spark.createDataFrame(rows, "_h string, n int, _n string").repartition(5)
    assert quality.duplicate_rows(df).first().asDict() == {"rows": 90, "duplicate_rows": 29 + 30}


def test_high_missing_limit_is_strict(spark):
    rows = [(i, None if i < 40 else 1.0, None if i < 41 else 1.0, None) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    assert [(r["column"], r["missing_pct"]) for r in quality.high_missing(df).collect()] == [("d", 100.0), ("c", 41.0)]


def test_constants(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, None)], "a int, b int, c int")
    assert [r["column"] for r in quality.constant_columns(df).collect()] == ["a", "b"]


def test_cardinality_limit(spark):
    df = spark.range(2000).select((F.col("id") % 100).cast("string").alias("at"), (F.col("id") % 101).cast("string").alias("over"))
    assert [r.asDict() for r in quality.high_cardinality(df).collect()] == [{"column": "over", "n_distinct": 101}]


def test_outlier_guards(spark):
    cases = {"flat": [1.0, 1.0, 1.0, 1.0, 9.0], "three": [1.0, 2.0, 99.0, None, None], "fence": [0.0, 1.0, 2.0, 3.0, 6.0],
             "out": [0.0, 1.0, 2.0, 3.0, 6.001]}
    pdf = pd.DataFrame(cases)
    df = spark.createDataFrame(list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)), ", ".join(f"{c} double" for c in cases))
    got = quality.iqr_outliers(df).collect()
    assert [(r["column"], r["n_outliers"], r["pct"]) for r in got] == [("out", 1, 20.0)]


def test_case_variants(spark):
    df = spark.createDataFrame([("Yes",), ("yes",), ("No",), (None,)], "s string")
    assert quality.case_inconsistency(df).first().asDict() == {"column": "s", "n_values": 3, "n_folded": 2}
    assert {r["value"] for r in quality.case_variants(df).collect()} == {"Yes", "yes"}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": a + 0.3 * rng.normal(size=400), "c": np.round(rng.gamma(1.0, size=400), 1), "d": 7.0})
    pdf.loc[rng.choice(400, 60, replace=False), "c"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def frame(spark, numbers):
    return spark.createDataFrame(list(numbers.astype(object).where(numbers.notna(), None).itertuples(index=False)), "a double, b double, c double, d double").cache()


def test_moments_match_pandas(frame, numbers):
    for r in eda.univariate(frame).collect():
        x = numbers[r["column"]]
        assert (r["n"], r["mean"], r["std"]) == (x.count(), pytest.approx(x.mean()), pytest.approx(x.std()))
        assert (r["skewness"], r["kurtosis"]) == (pytest.approx(x.skew()), pytest.approx(x.kurt()))


def test_describe_matches_pandas(frame, numbers):
    want = numbers.describe()
    for r in eda.describe(frame).collect():
        for mine, theirs in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("min", "min"), ("max", "max")):
            assert r[mine] == pytest.approx(want[r["column"]][theirs])


@pytest.mark.parametrize("method,op", [("pearson", eda.pearson_matrix), ("spearman", eda.spearman_matrix)])
def test_correlations_match_pandas(frame, numbers, method, op):
    want = numbers.corr(method=method)
    got = {(r["a"], r["b"]): r["r"] for r in op(frame).collect()}
    assert len(got) == 16
    for (a, b), r in got.items():
        if np.isnan(want.loc[a, b]):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_rank_join_with_hot_values_spread(frame, numbers, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", 5)
    monkeypatch.setattr(ranks, "HOT_SHARE", 20)
    held = frame.select("a", F.when(F.col("b") > 0, 1.0).otherwise(F.col("b")).alias("b"))
    want = pd.DataFrame({"a": numbers.a, "b": numbers.b.where(numbers.b <= 0, 1.0)}).corr(method="spearman").loc["a", "b"]
    assert eda.spearman_pairs(held).first()["r"] == pytest.approx(want)


def test_wide_tables_use_matrix_products(frame, numbers, monkeypatch):
    monkeypatch.setattr(eda, "WIDE_COLUMNS", 1)
    want = numbers.corr()
    for r in eda.pearson_pairs(frame.repartition(3)).collect():
        assert r["r"] is None if np.isnan(want.loc[r["a"], r["b"]]) else r["r"] == pytest.approx(want.loc[r["a"], r["b"]])


def test_top_lists(frame):
    best = eda.top_correlations(frame, top=2).collect()
    assert (best[0]["a"], best[0]["b"]) == ("a", "b")
    assert [r["column"] for r in eda.most_skewed(frame, top=1).collect()] == ["c"]
    levels = {(r["a"], r["b"]): r["level"] for r in causal.correlation_warnings(frame).collect()}
    assert levels == {("a", "b"): "strong"}


def test_information_prefers_dependence(spark, numbers):
    df = spark.createDataFrame(numbers[["a", "b"]].assign(z=np.random.default_rng(1).normal(size=400)))
    got = eda.mutual_information(df).collect()
    assert (got[0]["a"], got[0]["b"]) == ("a", "b") and got[0]["mi"] > 2 * got[1]["mi"]
    assert eda.mutual_information(df.limit(9)).count() == 0


def test_histogram_counts_every_value(frame, numbers):
    rows = eda.histogram(frame).collect()
    for c in numbers:
        bins = [r["n"] for r in sorted(rows, key=lambda r: r["bin"]) if r["column"] == c]
        assert len(bins) == 30 and sum(bins) == numbers[c].count()
    a = [r["n"] for r in sorted(rows, key=lambda r: r["bin"]) if r["column"] == "a"]
    assert a == np.histogram(numbers.a, 30)[0].tolist()


@pytest.mark.parametrize("values,ddl,expected", [
    (["A", "B"], "string", True), (["control", "Treatment", None], "string", True), ([0, 1, None], "int", True),
    (["F", "O"], "string", False), (["yes", "no", "maybe"], "string", False), ([0.0, 1.0], "double", False), ([True, False], "boolean", True),
])
def test_treatment(spark, values, ddl, expected):
    df = spark.createDataFrame([(v,) for v in values], f"g {ddl}")
    assert (causal.binary_treatment(df).count() == 1) is expected


@pytest.mark.parametrize("shape", ["spread", "hot", "outlier", "decades", "infinite", "tiny"])
@pytest.mark.parametrize("bracket", [1 << 17, 16])
def test_quantiles_match_numpy(spark, shape, bracket):
    rng = np.random.default_rng(5)
    x = {
        "spread": rng.normal(size=3000), "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(5, 1, 3000)),
        "outlier": np.append(rng.normal(size=2999), 1e18), "decades": 10.0 ** rng.uniform(-200, 200, 3000),
        "infinite": np.append(rng.normal(size=2990), [np.inf] * 5 + [-np.inf] * 5), "tiny": np.array([3.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("other", 1.0)], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in exact_quantiles(df, ["k"], "v", probs, bracket_rows=bracket).collect()}
    s = np.sort(x)
    want = [s[b] if w == 0 else s[b] * (1 - w) + s[b + 1] * w for _, b, w in quantiles.rank_positions(len(x), probs)]
    assert got["k"] == pytest.approx(want, rel=1e-12)
    assert got["other"] == [1.0] * 5


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_quantiles_of_many_groups_and_of_the_widest_values(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "BROADCAST_BRACKETS", few)
    rng = np.random.default_rng(6)
    groups = {f"g{i}": rng.normal(size=int(rng.integers(1, 9))) for i in range(400)}
    tops = np.array([-1.7e308, 1.7e308, 0.0, 4.9e-324, 9.9e-324, -4.9e-324])
    groups["wide"] = np.concatenate([rng.permutation(np.repeat(tops, 20)), 10.0 ** rng.uniform(-300, 300, 300), [0.5] * 500])
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("g1", None), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.25, 0.5, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(4)] for r in exact_quantiles(df, ["k"], "v", probs, bracket_rows=8).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        s = np.sort(x)
        want = [s[b] if w == 0 else s[b] * (1 - w) + s[b + 1] * w for _, b, w in quantiles.rank_positions(len(x), probs)]
        assert got[k] == pytest.approx(want, rel=1e-12), k


def test_approximate_quantiles_keep_their_rank(spark):
    rng = np.random.default_rng(7)
    x = {"spread": rng.normal(size=9000), "hot": np.where(rng.random(9000) < 0.4, 5.0, rng.normal(5, 1, 9000)), "one": np.array([2.0]), "inf": np.array([-np.inf, np.inf, 0.0])}
    rows = [(k, float(v)) for k, values in x.items() for v in values] + [(None, 1.0), ("spread", None), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for accuracy in (100, 100_000):
        got = {r["k"]: r for r in quantiles.approximate_quantiles(df, ["k"], "v", probs, accuracy).collect()}
        assert set(got) == set(x)
        for k, values in x.items():
            for i, p in enumerate(probs):
                answer, wanted = got[k][f"q{i}"], max(1, int(np.ceil(p * len(values))))
                assert answer in values
                assert (values < answer).sum() + 1 - len(values) / accuracy <= wanted <= (values <= answer).sum() + len(values) / accuracy
    assert quantiles.approximate_quantiles(df.limit(0), ["k"], "v", probs).count() == 0
    exact, near = (segments.segment_stats(df, ["k"], ["v"], exact=e).orderBy("cat").collect() for e in (True, False))
    assert [r["n"] for r in exact] == [r["n"] for r in near] and len(near) == 5
    assert quality.iqr_outliers(df, ["v"], exact=False).first()["n_outliers"] > 0


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "a double, b double, s string")
    assert eda.univariate(df).count() in (0, 2)
    assert eda.pearson_matrix(df).where("r is not null").count() == 0
    assert quality.iqr_outliers(df).count() == 0
    assert eda.histogram(df).count() == 0
    assert eda.top_correlations(df.select("s")).count() == 0
