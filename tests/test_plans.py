"""Plans of the data-sized operators: no whole-table window, no cross product of data, pruned scans."""

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sondeo.operators import eda, profile, quality, seasonality, segments, trend
from sondeo.plans import sequence as sq
from sondeo.plans.ranks import average_ranks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def check(df):
    text = plan(df)
    for line in text.splitlines():
        if re.search(r"(^|\s)Window \[", line):
            # windowspecdefinition lists the partition keys first; an empty list starts with the order
            assert not re.search(r"windowspecdefinition\(\w+#\d+L? (ASC|DESC)", line), line
    assert "CartesianProduct" not in text and "Exchange SinglePartition, REPARTITION" not in text
    return text


@pytest.fixture(scope="module")
def seq(tables):
    ev = tables("events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return sq.time_order(ev, F.col("ts"), ["user_id", "value"], sq.tie_break(ev, "ts"))


def test_sequence_plans_partition_by_block(seq):
    for df in (
        seq.filled, trend.rolling_mean(seq, 7, ["value"]), sq.with_lags(seq.filled, [1, 12], seq.block_rows),
        trend.trend_statistics(seq, ["user_id", "value"]), seasonality.lag_correlation(seq), seasonality.month_means(seq),
        sq.fill_gaps(sq.long_series(seq.table, ["value"]), seq.block_rows),
    ):
        text = check(df)
        if "Window [" in text:
            assert "block" in text


def test_gap_free_series_need_no_shuffle_before_the_aggregate(seq):
    text = check(trend.trend_statistics(seq, ["user_id"]))
    assert "Window" not in text and text.count("Exchange hashpartitioning") == 1


def test_scans_read_only_the_columns_asked_for(spark):
    li = spark.read.parquet(f"{DATA}/lineitem.parquet")
    text = check(eda.univariate(li, ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text
    text = check(segments.segment_moments(li, ["l_returnflag"], ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in text
    text = check(quality.case_inconsistency(li, ["l_linestatus"]))
    assert "ReadSchema: struct<l_linestatus:string>" in text


def test_value_counts_and_ranks_aggregate_before_the_shuffle(spark, tables):
    for df in (profile.value_counts(tables("orders"), ["o_orderstatus"]), average_ranks(tables("orders"), ["o_custkey"]).table):
        check(df)
    assert plan(profile.value_counts(tables("orders"), ["o_orderstatus"])).count("HashAggregate") == 2


def test_top_lists_do_not_sort_everything(tables):
    assert "TakeOrderedAndProject" in plan(trend.rank_by_variance(tables("lineitem"), ["l_tax", "l_quantity"], 1))
