"""Are residuals noise: bias, autocorrelation up to a lag, and runs of one sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions.columns import is_constant
from sondeo.functions.tails import chi2_p_value, normal_p_value, t_p_value
from sondeo.operators.trend import SIGNIFICANCE
from sondeo.plans.scratch import stored
from sondeo.plans.sequence import BLOCK_ROWS, lag_products, with_lags


def residual_diagnostics(residuals: DataFrame, lags: int = 10, fitted: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(series, n, bias, bias_p, ljung_box, ljung_box_p, runs, runs_z, runs_p, white_noise) of each series of (series, pos, y).

    Positions are consecutive; missing residuals belong to no forecast and must be left out at the ends only. The Ljung-Box sum has
    ``lags`` - ``fitted`` degrees of freedom and is NULL for a constant series or one of ``lags`` rows or fewer; the runs test is NULL where all
    signs agree (zero counts as positive). White noise: no test that has a value rejects. Runs one job, which stores the residuals.
    """
    if lags <= fitted:
        raise ValueError("more lags than fitted parameters are needed")
    # read three times
    held = stored(residuals.where(F.col("y").isNotNull()).select("series", "pos", "y"), "residuals")
    # signs are compared with the row before, also across a block border
    signed = with_lags(held, [1], block_rows).select("series", "y", (F.col("y") >= 0).alias("up"), (F.col("lag_1") >= 0).alias("was_up"))
    shape = signed.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("bias"), F.when(~is_constant(F.col("y")), F.stddev_samp("y")).alias("sd"),
        F.count_if("up").alias("n_up"), (1 + F.count_if(F.col("up") != F.col("was_up"))).alias("runs"),
    )
    # one row per series
    means = F.broadcast(held.groupBy("series").agg(F.avg("y").alias("mean")))
    centred = held.join(means, "series").select("series", "pos", (F.col("y") - F.col("mean")).alias("y"))
    totals = lag_products(centred, lags, block_rows).where("kind = 'yy'").groupBy("series").agg(
        F.max(F.when(F.col("lag") == 0, F.col("total"))).alias("g0"), *(F.coalesce(F.max(F.when(F.col("lag") == k, F.col("total"))), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)),
    )
    n = F.col("n").cast("double")
    joined = shape.join(F.broadcast(totals), "series")
    parts = sum((F.col(f"g{k}") * F.col(f"g{k}") / (n - k) for k in range(2, lags + 1)), F.col("g1") * F.col("g1") / (n - 1))
    box = F.when((F.col("n") > lags) & F.col("sd").isNotNull(), n * (n + 2) * parts / (F.col("g0") * F.col("g0")))
    up, down = F.col("n_up").cast("double"), n - F.col("n_up")
    expected = 2 * up * down / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z = F.when((up > 0) & (down > 0) & (spread > 0), (F.col("runs") - expected) / F.sqrt(spread))
    # residuals that are all the same and not zero are bias alone
    biased = F.when(F.col("sd") > 0, F.col("bias") / F.col("sd") * F.sqrt(n)).when((F.col("n") > 1) & (F.col("bias") != 0), F.signum("bias") * float("inf"))
    stats = joined.select("series", "n", "bias", biased.alias("bias_t"), box.alias("ljung_box"), "runs", z.alias("runs_z"))
    tested = stats.select(
        "series", "n", "bias", t_p_value(F.col("bias_t"), (F.col("n") - 1).cast("double")).alias("bias_p"), "ljung_box",
        chi2_p_value(F.col("ljung_box"), F.lit(float(lags - fitted))).alias("ljung_box_p"), "runs", "runs_z", normal_p_value(F.col("runs_z")).alias("runs_p"),
    )
    fine = [F.coalesce(F.col(p) >= SIGNIFICANCE, F.lit(True)) for p in ("bias_p", "ljung_box_p", "runs_p")]
    return tested.withColumn("white_noise", fine[0] & fine[1] & fine[2])
