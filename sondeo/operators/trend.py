"""Trend of ordered sequences: line fit, change, direction, rolling mean and mid-point break."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.columns import as_double, col, is_constant, unpivot, variance
from sondeo.functions.tails import t_p_value
from sondeo.plans.quantiles import exact_quantiles
from sondeo.plans.scratch import stored
from sondeo.plans.sequence import Sequence, measure_column, trailing_mean, with_lags

# Series of a report (``top=None`` takes all), change and significance that make a direction, minimum lengths, and the stand-in
# for a start of zero.
MAX_COLUMNS = 5
DIRECTION_PCT, SIGNIFICANCE = 10.0, 0.05
MIN_ROWS, MIN_HALF = 4, 3
ZERO_START = 1e-9
# Median gap in days -> rolling window.
DAILY, WEEKLY, SPARSE = 7, 4, 3

MICROS_PER_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    whole = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + clock
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def median_gap(seq: Sequence) -> DataFrame:
    """One row: the median difference of consecutive dates in microseconds (NULL under two rows)."""
    dates = seq.table.select(F.lit("t").alias("series"), "pos", micros(F.col("ts")).alias("y"))
    gaps = with_lags(dates, [1], seq.block_rows).select("series", (F.col("y") - F.col("lag_1")).cast("double").alias("gap"))
    gaps = gaps.where(F.col("gap").isNotNull())
    if seq.n < 2:
        return seq.table.sparkSession.createDataFrame([(None,)], "median_micros double")
    gaps = stored(gaps, "gaps")  # the quantile scans would repeat the block windows
    return exact_quantiles(gaps, ["series"], "gap", [0.5]).select(F.col("q0").alias("median_micros"))


def infer_rolling_window(seq: Sequence) -> DataFrame:
    """One row: the rolling window that suits the median gap."""
    days = F.floor(F.col("median_micros") / MICROS_PER_DAY)
    window = F.when(days.isNull() | (days <= 1), DAILY).when(days <= 7, WEEKLY).otherwise(SPARSE)
    return median_gap(seq).select("median_micros", window.alias("rolling_window"))


def rank_by_variance(df: DataFrame, columns: Seq[str], top: int | None = MAX_COLUMNS) -> DataFrame:
    """(column, variance): the measures with the largest sample variance."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, variance double")
    long = unpivot(df, {c: as_double(c) for c in columns})
    spread = long.groupBy("column").agg(F.var_samp("value").alias("variance"))
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    ranked = spread.orderBy(F.col("variance").desc_nulls_last(), order)
    return ranked.limit(top) if top else ranked


def trend_columns(seq: Sequence, top: int | None = MAX_COLUMNS) -> list[str]:
    measures = seq.table.select(*[col(measure_column(c)).alias(c) for c in seq.columns])
    return [r["column"] for r in rank_by_variance(measures, seq.columns, top).collect()]


def trend_statistics(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """One row per series from one aggregate: line fit, end points and both halves.

    Columns: series, n, slope, intercept, r2, t, t_df, start, end, pct_change, break_t, break_df.
    """
    columns = trend_columns(seq, top) if columns is None else columns
    usable = [c for c in columns if seq.present[c] and seq.n >= MIN_ROWS]
    y, pos, mid = F.col("y"), F.col("pos"), seq.n // 2
    centre = (seq.n - 1) / 2
    x = F.col("pos") - F.lit(centre)
    first, second = F.when(pos < mid, y), F.when(pos >= mid, y)
    sums = seq.series(usable).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("vy"), (~is_constant(y)).alias("varies"),
        F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"),
        F.min_by("y", "pos").alias("first"), F.max_by("y", "pos").alias("end"),
        F.count(first).alias("n1"), F.avg(first).alias("m1"), variance(first).alias("v1"),
        F.count(second).alias("n2"), F.avg(second).alias("m2"), variance(second).alias("v2"),
    )
    # a constant series has slope 0 and explains nothing
    varies = F.col("varies")
    slope = F.when(varies, F.col("cxy") / F.col("vx")).otherwise(0.0)
    r2 = F.when(varies, F.least(F.lit(1.0), F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy")))).otherwise(0.0)
    start = F.when(F.col("first") == 0, ZERO_START).otherwise(F.col("first"))
    fit = sums.select(
        "*", slope.alias("slope"), r2.alias("r2"), start.alias("start"), (F.col("n") - 2).alias("t_df"),
        (F.col("v1") / F.col("n1")).alias("e1"), (F.col("v2") / F.col("n2")).alias("e2"),
    )
    r = F.signum("slope") * F.sqrt("r2")
    t = F.when(F.col("r2") < 1, r * F.sqrt(F.col("t_df") / (1 - F.col("r2")))).otherwise(F.signum("slope") * float("inf"))
    halves = (F.col("n1") >= MIN_HALF) & (F.col("n2") >= MIN_HALF) & (F.col("e1") + F.col("e2") > 0)
    error = F.col("e1") + F.col("e2")
    break_df = error * error / (
        F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1)
    )
    return fit.select(
        "series", "n", "slope", (F.col("mean") - F.col("slope") * F.lit(centre)).alias("intercept"), "r2", t.alias("t"), "t_df",
        "start", "end", ((F.col("end") - F.col("start")) / F.abs("start") * 100).alias("pct_change"),
        F.when(halves, (F.col("m1") - F.col("m2")) / F.sqrt(error)).alias("break_t"),
        F.when(halves, break_df).alias("break_df"),
    )


def ols_trend(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    stats = trend_statistics(seq, columns, top)
    return stats.select("series", "slope", "intercept", "r2", "t", t_p_value(F.col("t"), F.col("t_df").cast("double")).alias("p_value"))


def pct_change(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    return trend_statistics(seq, columns, top).select("series", "start", "end", "pct_change")


def structural_break(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """Welch test of the two halves; no verdict (false) when a half is short or nothing varies."""
    stats = trend_statistics(seq, columns, top)
    p = t_p_value(F.col("break_t"), F.col("break_df"))
    tested = stats.select("series", "break_t", "break_df", p.alias("break_p"))
    return tested.withColumn("structural_break", F.coalesce(F.col("break_p") < SIGNIFICANCE, F.lit(False)))


def trend_table(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """One row per series, largest variance first: fit, change, direction and break."""
    columns = trend_columns(seq, top) if columns is None else list(columns)
    stats = trend_statistics(seq, columns, top)
    tested = stats.select(
        "*", t_p_value(F.col("t"), F.col("t_df").cast("double")).alias("p_value"),
        t_p_value(F.col("break_t"), F.col("break_df")).alias("break_p"),
    )
    moved = (F.abs("pct_change") > DIRECTION_PCT) & (F.col("p_value") < SIGNIFICANCE)
    direction = F.when(moved & (F.col("pct_change") > 0), "upward").when(moved, "downward").otherwise("stable")
    order = F.array_position(F.array(*[F.lit(c) for c in columns]).cast("array<string>"), F.col("series"))
    return tested.orderBy(order).select(
        F.col("series").alias("column"), "slope", "r2", "p_value", "start", "end", "pct_change",
        direction.alias("direction"), F.coalesce(F.col("break_p") < SIGNIFICANCE, F.lit(False)).alias("structural_break"),
        order.cast("int").alias("ordinal"),
    )


def trend_direction(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    return trend_table(seq, columns, top).select("column", "pct_change", "p_value", "direction")


def rolling_mean(seq: Sequence, window: int, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """(series, pos, y, rolling_mean) over the gap-filled series."""
    columns = trend_columns(seq, top) if columns is None else columns
    return trailing_mean(seq.series(columns), window, seq.block_rows)


def ols_fitted_line(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """(series, pos, y, fitted): the line of the trend fit at every row."""
    columns = trend_columns(seq, top) if columns is None else columns
    lines = trend_statistics(seq, columns, top).select("series", "slope", "intercept")
    points = seq.series(columns).join(F.broadcast(lines), "series")  # one line per series
    return points.select("series", "pos", "y", (F.col("intercept") + F.col("slope") * F.col("pos")).alias("fitted"))


def break_marker(seq: Sequence, columns: Seq[str] | None = None, top: int | None = MAX_COLUMNS) -> DataFrame:
    """(series, pos, ts) of the middle row for every series with a break."""
    broken = structural_break(seq, columns, top).where("structural_break").select("series")
    middle = seq.table.where(F.col("pos") == seq.n // 2).select("pos", "ts")
    if seq.n < MIN_ROWS:
        middle = middle.limit(0)
    return broken.crossJoin(F.broadcast(middle))  # one middle row
