"""Trend, autocorrelation and rolling mean of every entity of a panel."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions.columns import is_constant
from sondeo.functions.tails import t_p_value
from sondeo.operators.autocorrelation import MIN_ROWS as MIN_ACF_ROWS
from sondeo.operators.trend import DIRECTION_PCT, MIN_ROWS, SIGNIFICANCE, ZERO_START
from sondeo.plans.panel import Panel
from sondeo.plans.sequence import trailing_mean, with_lags

MAX_LAGS = 10


def panel_trend(panel: Panel, columns: Seq[str] | None = None) -> DataFrame:
    """(by, column, n, slope, intercept, r2, p_value, start, end, pct_change, direction) of every entity of four rows or more.

    One aggregate over the gap-filled rows: sums are combined in every task before they move.
    """
    sums = panel.series(columns).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.avg("pos").alias("centre"), F.var_pop("y").alias("vy"), F.var_pop("pos").alias("vx"),
        F.covar_pop("pos", "y").alias("cxy"), (~is_constant(F.col("y"))).alias("varies"), F.min_by("y", "pos").alias("first"), F.max_by("y", "pos").alias("end"),
    ).where(F.col("n") >= MIN_ROWS)
    varies = F.col("varies")
    fit = sums.select(
        "*", F.when(varies, F.col("cxy") / F.col("vx")).otherwise(0.0).alias("slope"),
        F.when(varies, F.least(F.lit(1.0), F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy")))).otherwise(0.0).alias("r2"),
        F.when(F.col("first") == 0, ZERO_START).otherwise(F.col("first")).alias("start"),
    )
    t = F.when(F.col("r2") < 1, F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))).otherwise(F.signum("slope") * float("inf"))
    tested = fit.select("*", t_p_value(t, (F.col("n") - 2).cast("double")).alias("p_value"), ((F.col("end") - F.col("start")) / F.abs("start") * 100).alias("pct_change"))
    moved = (F.abs("pct_change") > DIRECTION_PCT) & (F.col("p_value") < SIGNIFICANCE)
    direction = F.when(moved & (F.col("pct_change") > 0), "upward").when(moved, "downward").otherwise("stable")
    return panel.named(tested.select(
        "series", "n", "slope", (F.col("mean") - F.col("slope") * F.col("centre")).alias("intercept"), "r2", "p_value", "start", "end", "pct_change", direction.alias("direction"),
    ))


def panel_acf(panel: Panel, columns: Seq[str] | None = None, max_lags: int = MAX_LAGS) -> DataFrame:
    """(by, column, lag, acf) for lag 0 to the smaller of ``max_lags`` and n // 2 - 1 of every entity of 15 rows or more.

    NULL for a constant series. Lags are read inside blocks of one entity and summed in every task.
    """
    filled = panel.series(columns)
    means = filled.groupBy("series").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"), is_constant(F.col("y")).alias("flat")).where(F.col("n") >= MIN_ACF_ROWS)
    # one row per entity; a large entity's rows are many against its one, which adaptive execution splits
    centred = filled.join(means, "series").select("series", "pos", "n", "flat", (F.col("y") - F.col("mean")).alias("y"))
    lags = range(1, max_lags + 1)
    lagged = with_lags(centred, list(lags), panel.block_rows)
    sums = lagged.groupBy("series").agg(
        F.first("n").alias("n"), F.first("flat").alias("flat"), F.sum(F.col("y") * F.col("y")).alias("s0"), *(F.coalesce(F.sum(F.col("y") * F.col(f"lag_{k}")), F.lit(0.0)).alias(f"s{k}") for k in lags),
    )
    each = sums.select("series", "n", "flat", "s0", F.posexplode(F.array(*(F.col(f"s{k}") for k in (0, *lags)))).alias("lag", "total"))
    short = F.col("lag") <= F.floor(F.col("n") / 2) - 1
    return panel.named(each.where(short).select("series", "lag", F.when(~F.col("flat"), F.try_divide("total", "s0")).alias("acf")))


def panel_rolling_mean(panel: Panel, window: int, columns: Seq[str] | None = None) -> DataFrame:
    """(by, column, pos, y, rolling_mean) over the gap-filled rows of every entity."""
    return panel.named(trailing_mean(panel.series(columns), window, panel.block_rows).select("series", "pos", "y", "rolling_mean"))
