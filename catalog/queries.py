"""One query per operator. Numbers are rounded so that two engines' last bits do not differ."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo import sources
from sondeo.functions.columns import as_double, unpivot
from sondeo.operators import autocorrelation as ac
from sondeo.operators import causal, diagnostics, drift, eda, forecast, panel, profile, quality, report, seasonality, segments, stationarity, transforms, trend
from sondeo.operators.pipeline import analyze
from sondeo.plans.panel import Panel, panel_order
from sondeo.plans.quantiles import ACCURACY
from sondeo.plans.scratch import scratch_folder, stored
from sondeo.plans.sequence import Sequence, long_series, time_order, with_lags
from sondeo.streaming.windows import WindowedProfile, wall_micros

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY_TEXT = ["event_type", "props"]
EIGHT_MEASURES = ["l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SERIES = ["user_id", "value", "cycle", "stepped"]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return sources.read_parquet(spark, f"{folder}/{name}.parquet")


def tidy(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round doubles, widen integers and keep the rest, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.round(f.name, decimals).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def to_cents(df: DataFrame) -> DataFrame:
    """Percentages at two decimals; one of a zero start is about 1e11 and has no more to give."""
    return df.withColumn("pct_change", F.round("pct_change", 2))


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with gaps, case clashes, repeated rows and empty, constant and sparse columns."""
    ev = table(spark, folder, "events")
    ident = F.col("event_id")
    flawed = ev.select(
        "event_id", "ts", "user_id",
        F.when(ident % 7 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(ident % 10 != 0, F.col("value")).alias("value"), "props",
        F.lit(1).alias("fixed"), F.lit(None).cast("double").alias("empty"),
        F.when(ident % 5 < 2, F.col("value")).alias("sparse"),
    )
    return flawed.unionByName(flawed.where(ident % 50 == 0))


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    ident = F.col("event_id")
    step = F.when(F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz"), 40).otherwise(0)
    return ev.select(
        "event_id", "ts", F.col("user_id").cast("double").alias("user_id"),
        F.when(ident % 10 != 0, F.col("value")).alias("value"), (ident % 7).cast("double").alias("cycle"),
        (F.col("value") + step).alias("stepped"),
    )


def event_sequence(spark: SparkSession, folder: str, measures=tuple(SERIES)) -> Sequence:
    return time_order(gappy_events(spark, folder), F.col("ts"), list(measures), [F.col("event_id")])


def order_sequence(spark: SparkSession, folder: str, measures=("o_totalprice",)) -> Sequence:
    return time_order(table(spark, folder, "orders"), F.col("o_orderdate"), list(measures), [F.col("o_orderkey")])


# --- sources -----------------------------------------------------------------------------------------------


@query
def csv_scan(spark, folder):
    ev = table(spark, folder, "events")
    marked = ev.select(
        "event_id", "event_type", F.when(F.col("event_id") % 10 == 0, "NA").otherwise(F.col("value").cast("string")).alias("value"),
        (F.col("event_id") + 9_000_000_000_000_000_000).alias("long_id"), (F.col("event_id") + F.lit(str(10**20)).cast("decimal(38,0)")).alias("wide_id"),
        F.concat("event_type", F.lit("\n\"second\" line, "), "event_type").alias("note"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")).alias("at"),
    )
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    marked.write.csv(path, header=True, escape='"')
    back = sources.read_csv(spark, path, multi_line=True)
    types = {f.name: f.dataType.simpleString() for f in back.schema.fields}
    return tidy(back.agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.sum("value").alias("total"),
        F.lit(types["event_id"]).alias("id_type"), F.lit(types["value"]).alias("value_type"),
        F.count_distinct("long_id").alias("long_ids"), F.max("long_id").cast("string").alias("last_long_id"),
        F.max("wide_id").cast("string").alias("last_wide_id"), F.count_if(F.col("note").contains("\n\"second\" line, ")).alias("broken_lines"),
        F.min("at").cast("string").alias("first_at"),
    ), 2)


@query
def sink_round_trip(spark, folder):
    """Result tables written to files of each format and read again."""
    means = month_means(spark, folder)
    out = None
    for fmt in ("parquet", "orc", "json", "csv"):
        path = f"{scratch_folder(spark)}/sink-{uuid.uuid4().hex}"
        sources.write_result(means, path, fmt)
        back = spark.read.schema(means.schema).format(fmt).load(path).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query
def column_kinds(spark, folder):
    """The kind of every column of four tables, next to its values that are not missing."""
    out = None
    for name in ("lineitem", "orders", "events", "embeddings"):
        df = table(spark, folder, name)
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n")
        kinds = profile.column_kinds(df).join(counts, "column").select(F.lit(name).alias("table"), "column", "kind", "n")
        out = kinds if out is None else out.unionByName(kinds)
    return out


@query
def preview(spark, folder):
    return sources.preview(table(spark, folder, "events"))


# --- profile -----------------------------------------------------------------------------------------------


@query
def shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query
def size_estimate(spark, folder):
    return tidy(profile.size_estimate(table(spark, folder, "documents")))


@query
def detect_date_column(spark, folder):
    day = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_day")
    return tidy(profile.detect_date_column(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", day)))


@query
def missing_profile(spark, folder):
    return tidy(profile.missing_profile(dirty_events(spark, folder)))


@query
def classify_dataset(spark, folder):
    frames = []
    for name, column in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        found = profile.classify_dataset(table(spark, folder, name), F.col(column))
        frames.append(found.withColumn("table", F.lit(name)))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def identifier_columns(spark, folder):
    return tidy(profile.identifier_columns(table(spark, folder, "customer")))


@query
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query
def profile_table(spark, folder):
    return tidy(profile.profile_table(table(spark, folder, "orders")))


@query
def profile_summary(spark, folder):
    return profile.profile_summary(table(spark, folder, "events"))


# --- quality -----------------------------------------------------------------------------------------------


@query
def duplicate_rows(spark, folder):
    return quality.duplicate_rows(dirty_events(spark, folder))


@query
def high_missing(spark, folder):
    return tidy(quality.high_missing(dirty_events(spark, folder)))


@query
def constant_columns(spark, folder):
    return quality.constant_columns(dirty_events(spark, folder))


@query
def high_cardinality(spark, folder):
    return quality.high_cardinality(table(spark, folder, "documents"), ["text", "lang", "source"])


@query
def iqr_outliers(spark, folder):
    return tidy(quality.iqr_outliers(dirty_events(spark, folder), ["user_id", "value", "sparse", "fixed"]), 4)


@query
def case_inconsistency(spark, folder):
    return quality.case_inconsistency(dirty_events(spark, folder), DIRTY_TEXT)


@query
def case_variants(spark, folder):
    return quality.case_variants(dirty_events(spark, folder), DIRTY_TEXT)


@query
def case_variants_long(spark, folder):
    """Spellings far longer than what is grouped as it is; every seventh text stands there in capitals as well."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    loud = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    both = docs.unionByName(docs.where(F.col("doc_id") % 7 == 0).withColumn("text", loud))
    found = quality.case_variants(both, ["text"])
    return found.select("column", F.sha2("folded", 256).alias("folded"), F.sha2("value", 256).alias("value"), "n")


# --- exploration -------------------------------------------------------------------------------------------


@query
def univariate(spark, folder):
    return tidy(eda.univariate(table(spark, folder, "lineitem"), LINEITEM), 4)


@query
def describe(spark, folder):
    return tidy(eda.describe(table(spark, folder, "lineitem"), LINEITEM), 4)


@query
def skewness(spark, folder):
    return tidy(eda.skewness(dirty_events(spark, folder), ["user_id", "value", "sparse", "fixed", "empty"]))


@query
def kurtosis(spark, folder):
    return tidy(eda.kurtosis(dirty_events(spark, folder), ["user_id", "value", "sparse", "fixed", "empty"]))


@query
def most_skewed(spark, folder):
    return tidy(eda.most_skewed(table(spark, folder, "lineitem"), LINEITEM), 5)


@query
def pearson_matrix(spark, folder):
    return tidy(eda.pearson_matrix(table(spark, folder, "lineitem"), LINEITEM))


@query
def pearson_pairs(spark, folder):
    names = ["event_id", "user_id", "value", "sparse", "fixed", "empty"]
    return tidy(eda.pearson_pairs(dirty_events(spark, folder), names).select("a", "b", "r"))


@query
def spearman_matrix(spark, folder):
    return tidy(eda.spearman_matrix(table(spark, folder, "lineitem"), LINEITEM))


@query
def spearman_pairs(spark, folder):
    return tidy(eda.spearman_pairs(dirty_events(spark, folder), ["user_id", "value", "sparse"]).select("a", "b", "r"))


@query
def average_rank(spark, folder):
    return tidy(eda.average_rank(table(spark, folder, "orders"), ["o_custkey", "o_totalprice"]))


@query
def top_correlations(spark, folder):
    li = table(spark, folder, "lineitem")
    wide = li.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return tidy(eda.top_correlations(wide, [*LINEITEM, "net"]).select("a", "b", "r"))


@query
def mutual_information(spark, folder):
    return tidy(eda.mutual_information(table(spark, folder, "lineitem"), LINEITEM))


@query
def categorical_cardinality(spark, folder):
    return eda.categorical_cardinality(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query
def histogram(spark, folder):
    return tidy(eda.histogram(table(spark, folder, "lineitem"), ["l_partkey", "l_quantity", "l_extendedprice", "l_orderkey", "l_suppkey", "l_tax"]), 4)


# --- causality ---------------------------------------------------------------------------------------------


@query
def correlation_warnings(spark, folder):
    li = table(spark, folder, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    wide = li.select("l_quantity", "l_extendedprice", net.alias("net"), (F.col("l_quantity") * 2000 + net).alias("blend"))
    return tidy(causal.correlation_warnings(wide))


@query
def binary_treatment(spark, folder):
    return causal.binary_treatment(table(spark, folder, "labels"))


# --- ordered sequences -------------------------------------------------------------------------------------


@query
def with_position(spark, folder):
    seq = order_sequence(spark, folder, ("o_orderkey", "o_totalprice"))
    return tidy(seq.table.select("pos", "o_orderkey", "o_totalprice"))


@query
def interpolate_linear(spark, folder):
    return tidy(event_sequence(spark, folder, ("value",)).series(["value"]))


@query
def lag_within_series(spark, folder):
    seq = event_sequence(spark, folder, ("value", "stepped"))
    return tidy(with_lags(long_series(seq.table, seq.columns), [1, 7], seq.block_rows))


@query
def infer_rolling_window(spark, folder):
    gap = trend.infer_rolling_window(event_sequence(spark, folder, ()))
    return tidy(gap.withColumn("source", F.lit("events")).unionByName(
        trend.infer_rolling_window(order_sequence(spark, folder, ())).withColumn("source", F.lit("orders"))), 1)


@query
def rank_by_variance(spark, folder):
    return tidy(trend.rank_by_variance(table(spark, folder, "lineitem"), LINEITEM), 4)


@query
def ols_trend(spark, folder):
    return tidy(trend.ols_trend(event_sequence(spark, folder), SERIES))


@query
def pct_change(spark, folder):
    return tidy(to_cents(trend.pct_change(event_sequence(spark, folder), SERIES)), 4)


@query
def trend_direction(spark, folder):
    return tidy(to_cents(trend.trend_direction(event_sequence(spark, folder), SERIES)), 4)


@query
def rolling_mean(spark, folder):
    seq = event_sequence(spark, folder, ("value", "stepped"))
    return tidy(trend.rolling_mean(seq, trend.DAILY, ["value", "stepped"]))


@query
def structural_break(spark, folder):
    return tidy(trend.structural_break(event_sequence(spark, folder), SERIES), 5)


@query
def ols_fitted_line(spark, folder):
    return tidy(trend.ols_fitted_line(order_sequence(spark, folder), ["o_totalprice"]), 3)


@query
def break_marker(spark, folder):
    marks = trend.break_marker(event_sequence(spark, folder), SERIES)
    return marks.select("series", "pos", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def trend_table(spark, folder):
    return tidy(to_cents(trend.trend_table(event_sequence(spark, folder))), 4)


@query
def month_means(spark, folder):
    return tidy(seasonality.month_means(order_sequence(spark, folder)), 4)


@query
def weekday_means(spark, folder):
    return tidy(seasonality.weekday_means(event_sequence(spark, folder)), 4)


@query
def lag_correlation(spark, folder):
    return tidy(seasonality.lag_correlation(event_sequence(spark, folder)))


@query
def seasonal_class(spark, folder):
    return tidy(seasonality.seasonal_class(event_sequence(spark, folder)))


@query
def calendar_box_stats(spark, folder):
    return tidy(seasonality.calendar_box_stats(event_sequence(spark, folder), ["value", "cycle"]), 4)


@query
def adf_test(spark, folder):
    return tidy(stationarity.adf_test(event_sequence(spark, folder)), 4)


@query
def kpss_test(spark, folder):
    return tidy(stationarity.kpss_test(event_sequence(spark, folder)), 5)


@query
def joint_verdict(spark, folder):
    seq = event_sequence(spark, folder)
    sums = stationarity.sequence_sums(seq)
    return stationarity.joint_verdict(stationarity.adf_test(seq, sums=sums), stationarity.kpss_test(seq, sums=sums))


@query
def stationarity_table(spark, folder):
    return stationarity.stationarity_table(event_sequence(spark, folder))


@query
def recommend_transform(spark, folder):
    seq = event_sequence(spark, folder)
    verdicts = stationarity.joint_verdict(stationarity.adf_test(seq), stationarity.kpss_test(seq)).select("series", "verdict")
    return stationarity.recommend_transform(seq, verdicts)


@query
def acf(spark, folder):
    return tidy(ac.acf(event_sequence(spark, folder)))


@query
def pacf(spark, folder):
    return tidy(ac.pacf(event_sequence(spark, folder)))


@query
def lag_pairs(spark, folder):
    return tidy(ac.lag_pairs(event_sequence(spark, folder, ("value", "user_id"))), 4)


@query
def confidence_band(spark, folder):
    return tidy(ac.confidence_band(event_sequence(spark, folder)))


@query
def significant_lags(spark, folder):
    return tidy(ac.significant_lags(event_sequence(spark, folder)))


@query
def arima_order_hint(spark, folder):
    return tidy(ac.arima_order_hint(event_sequence(spark, folder)))


@query
def correlogram(spark, folder):
    return tidy(ac.correlogram(event_sequence(spark, folder)))


# --- panels ------------------------------------------------------------------------------------------------


def customer_panel(spark: SparkSession, folder: str) -> Panel:
    """The orders of each customer in time, a tenth of the prices missing."""
    orders = table(spark, folder, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    return panel_order(orders, ["o_custkey"], F.col("o_orderdate"), ["price"], [F.col("o_orderkey")])


@query
def panel_trend(spark, folder):
    found = to_cents(panel.panel_trend(customer_panel(spark, folder)))
    return tidy(found.withColumns({c: F.round(c, 5) for c in ("r2", "p_value")}), 6)


@query
def panel_acf(spark, folder):
    return tidy(panel.panel_acf(customer_panel(spark, folder), max_lags=5))


@query
def panel_rolling_mean(spark, folder):
    return tidy(panel.panel_rolling_mean(customer_panel(spark, folder), 3), 6)


# --- transforms --------------------------------------------------------------------------------------------

TRANSFORMS = {"value": "first_difference", "stepped": "detrend", "cycle": "seasonal_difference", "positive": "first_difference + log_transform", "user_id": "none"}


def positive_sequence(spark: SparkSession, folder: str) -> Sequence:
    events = gappy_events(spark, folder).withColumn("positive", F.col("user_id") + 1)
    return time_order(events, F.col("ts"), list(TRANSFORMS), [F.col("event_id")])


@query
def apply_transforms(spark, folder):
    return tidy(transforms.transformed(positive_sequence(spark, folder), TRANSFORMS).drop("base"), 5)


@query
def transform_round_trip(spark, folder):
    """The inverse of every transform gives the gap-filled series again."""
    seq = positive_sequence(spark, folder)
    there = stored(transforms.transformed(seq, TRANSFORMS), "transformed")
    return tidy(transforms.restored(there, TRANSFORMS, 7, seq.block_rows), 5)


# --- forecasts ---------------------------------------------------------------------------------------------


@query
def rolling_origin(spark, folder):
    """Errors by method and step over origins every 100 rows, fits expanding."""
    seq = event_sequence(spark, folder, ("value", "cycle", "stepped"))
    found = forecast.rolling_origin(seq, horizon=10, every=100, first=14, season=7, window=7)
    return tidy(forecast.forecast_errors(found, ["series", "step"]), 5)


@query
def rolling_origin_sliding(spark, folder):
    """Every forecast of fits to the last 50 rows."""
    seq = event_sequence(spark, folder, ("value", "stepped"))
    return tidy(forecast.rolling_origin(seq, horizon=5, every=40, first=20, season=3, window=5, train_rows=50), 5)


@query
def panel_forecast_errors(spark, folder):
    """Errors of log prices per customer and method, one and two orders ahead of every order from the fourth."""
    orders = table(spark, folder, "orders").withColumn("log_price", F.when(F.col("o_orderkey") % 10 != 0, F.ln("o_totalprice")))
    customers = panel_order(orders, ["o_custkey"], F.col("o_orderdate"), ["log_price"], [F.col("o_orderkey")])
    found = forecast.rolling_origin(customers, horizon=2, every=1, first=3, season=2, window=3)
    return tidy(forecast.forecast_errors(found, ["o_custkey", "column"]), 5)


@query
def baseline_forecast(spark, folder):
    return tidy(forecast.baseline_forecast(event_sequence(spark, folder, ("value", "cycle", "stepped")), 10, 7, 7), 5)


@query
def residual_diagnostics(spark, folder):
    """What naive forecasts and fitted lines leave over."""
    seq = event_sequence(spark, folder)
    left = transforms.transformed(seq, {"value": "first_difference", "stepped": "detrend", "user_id": "detrend", "cycle": "first_difference"})
    found = diagnostics.residual_diagnostics(left.withColumnRenamed("value", "y"), 10, block_rows=seq.block_rows)
    return tidy(found, 5)


# --- drift -------------------------------------------------------------------------------------------------

DRIFTING = ["l_quantity", "price", "l_orderkey", "hot", "fixed", "past"]


def shipped(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    """Lines before and from mid 1998: some values moved, one that holds a third of its column, and one that ends."""
    late = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    return table(spark, folder, "lineitem").select(
        "l_quantity", "l_orderkey", (F.col("l_extendedprice") * F.when(late, 1.2).otherwise(1.0)).alias("price"),
        F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_discount")).alias("hot"), F.lit(1.0).alias("fixed"), F.when(~late, F.col("l_tax")).alias("past"),
        "l_returnflag", F.when(late & (F.col("l_linenumber") == 1), "moved").otherwise(F.col("l_linestatus")).alias("status"), "l_shipdate",
        F.when(F.col("l_orderkey") % 11 != 0, late).alias("late"),
    ), F.col("late")


@query
def numeric_drift(spark, folder):
    return tidy(drift.numeric_drift(*shipped(spark, folder), DRIFTING))


@query
def category_drift(spark, folder):
    return tidy(drift.category_drift(*shipped(spark, folder), ["l_returnflag", "status"]))


# --- streams -----------------------------------------------------------------------------------------------


def streamed_events(spark: SparkSession, folder: str) -> WindowedProfile:
    """Events arriving in four parts, every 20th three days late and every 97th without a time, each part taken in by its own run."""
    ident = F.col("event_id")
    ev = dirty_events(spark, folder).withColumn("ts", F.when(ident % 97 != 0, F.col("ts"))).withColumn("step", F.unix_date(F.col("ts").cast("date")))
    arrival = wall_micros(F.col("ts")) + F.when(ident % 20 == 0, 3 * 86_400_000_000).otherwise(0)
    ends = ev.agg(F.min(arrival).alias("first"), F.max(arrival).alias("last")).first()
    part = F.coalesce(F.floor((arrival - ends["first"]) * 4 / (ends["last"] - ends["first"] + 1)), F.lit(0))
    home = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    kept = WindowedProfile(home, "ts", ["value", "event_type", "step", "sparse", "empty"], width=86_400, lateness=86_400)
    for i in range(4):
        ev.where(part == i).write.mode("append").parquet(f"{home}/source")
        kept.advance(spark.readStream.schema(ev.schema).parquet(f"{home}/source"))
    return kept


@query
def stream_profile(spark, folder):
    return tidy(streamed_events(spark, folder).profile(spark), 5)


@query
def stream_arrivals(spark, folder):
    return tidy(streamed_events(spark, folder).arrivals(spark))


# --- segments ----------------------------------------------------------------------------------------------


@query
def usable_segments(spark, folder):
    return tidy(segments.usable_segments(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query
def segment_stats_by_customer(spark, folder):
    """A key with as many values as there are customers."""
    return tidy(segments.segment_stats(table(spark, folder, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"]))


@query
def approximate_quartiles(spark, folder):
    """Quartiles from one scan, each with the check that its rank is off by one in ACCURACY rows at most."""
    names = ["l_quantity", "l_extendedprice", "l_tax", "l_orderkey"]
    li = table(spark, folder, "lineitem")
    answers = eda.describe(li, names, exact=False).select("column", "n", F.inline(F.array(*[
        F.struct(F.lit(p).alias("prob"), F.col(q).alias("answer")) for p, q in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    ])))
    # four columns by three answers beside every row, as counts only
    values = unpivot(li.select(*names), {c: as_double(c) for c in names}, name="column", value="v").where("v is not null")
    ranks = values.join(F.broadcast(answers), "column").groupBy("column", "n", "prob", "answer").agg(
        F.count_if(F.col("v") < F.col("answer")).alias("below"), F.count_if(F.col("v") <= F.col("answer")).alias("upto")
    )
    wanted = F.ceil(F.col("prob") * F.col("n"))
    off = F.greatest(F.col("below") + 1 - wanted, wanted - F.col("upto"), F.lit(0))
    is_value, within = F.col("upto") > F.col("below"), off <= F.ceil(F.col("n") / ACCURACY)
    return ranks.select("column", "prob", "n", is_value.alias("is_value"), within.alias("within_error"))


@query
def segment_stats(spark, folder):
    li = table(spark, folder, "lineitem")
    return tidy(segments.segment_stats(li, ["l_returnflag", "l_linestatus"], EIGHT_MEASURES), 4)


@query
def anova(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(segments.anova(orders, ["o_orderstatus", "o_orderpriority"], ["o_custkey", "o_totalprice"]))


@query
def top_grouping(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(segments.top_grouping(orders, ["o_orderstatus", "o_orderpriority"], ["o_custkey", "o_totalprice"]))


@query
def top_bottom_segments(spark, folder):
    return tidy(segments.top_bottom_segments(table(spark, folder, "part"), "p_brand", "p_size"), 4)


@query
def segment_mean_bars(spark, folder):
    return tidy(segments.segment_mean_bars(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal"), 4)


# --- report ------------------------------------------------------------------------------------------------


@query
def kpis(spark, folder):
    df = dirty_events(spark, folder)
    trends = trend.trend_table(event_sequence(spark, folder)).count()
    return tidy(report.kpis(df, F.col("ts"), trends, quality.duplicate_rows(df)))


@query
def trend_statements(spark, folder):
    return report.trend_statements(trend.trend_table(event_sequence(spark, folder)))


@query
def relationship_statements(spark, folder):
    li = table(spark, folder, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    wide = li.select("l_quantity", "l_extendedprice", net.alias("net"), (F.col("l_quantity") * 2000 - net).alias("blend"))
    return report.relationship_statements(eda.top_correlations(wide))


@query
def technical_findings(spark, folder):
    return analyze(table(spark, folder, "events")).results["technical_findings"]


@query
def business_findings(spark, folder):
    return analyze(table(spark, folder, "customer")).results["business_findings"]


@query
def recommended_action(spark, folder):
    """The next step for the orders, for the events, and for the events without their series that move."""
    orders, events = table(spark, folder, "orders"), gappy_events(spark, folder)
    p = profile.build_profile(orders)
    warnings = causal.correlation_warnings(orders, profile=p)
    found = {"orders": report.recommended_action(p, spark, {"correlation_warnings": warnings, "trend_table": stored(trend.trend_table(order_sequence(spark, folder)), "trend")})}
    p, seq = profile.build_profile(events), event_sequence(spark, folder)
    tables = {"stationarity_table": stored(stationarity.stationarity_table(seq), "stationarity"), "trend_table": stored(trend.trend_table(seq), "trend")}
    found["events"] = report.recommended_action(p, spark, tables)
    tables["stationarity_table"] = tables["stationarity_table"].where("verdict = 'stationary'")
    found["events at rest"] = report.recommended_action(p, spark, tables)
    named = [action.select(F.lit(name).alias("source"), "action") for name, action in found.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def stage_status(spark, folder):
    return analyze(table(spark, folder, "part")).stage_status(spark)
