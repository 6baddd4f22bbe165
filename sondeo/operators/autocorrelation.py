"""Autocorrelation, partial autocorrelation and what they suggest."""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.tails import partial_autocorrelations
from sondeo.plans.sequence import Sequence, lag_products, with_lags

# Lags of a report, minimum length, reported lags, width of the 95 % band.
MAX_LAGS, MIN_ROWS = 40, 15
REPORTED_LAGS = (1, 7, 14, 30)
BAND_Z, EMPTY_BAND = 1.96, 0.2
DECIMALS = 4


def _columns(seq: Sequence, columns: Seq[str] | None) -> list[str]:
    usable = seq.usable(MIN_ROWS)
    return usable if columns is None else [c for c in columns if c in usable]


def lag_count(n: int, max_lags: int = MAX_LAGS) -> int:
    return min(max_lags, n // 2 - 1)


def band(n: int) -> float:
    return BAND_Z / math.sqrt(n) if n > 0 else EMPTY_BAND


def centred(series: DataFrame) -> DataFrame:
    """(series, pos, y): deviations from the series mean. One small aggregate, joined back."""
    means = series.groupBy("series").agg(F.avg("y").alias("mean"))  # one row per series
    return series.join(F.broadcast(means), "series").select("series", "pos", (F.col("y") - F.col("mean")).alias("y"))


def acf(seq: Sequence, columns: Seq[str] | None = None, max_lags: int = MAX_LAGS) -> DataFrame:
    """(series, lag, acf) for lag 0 up to the limit; NULL for a constant series."""
    names = _columns(seq, columns)
    if not names:
        return seq.table.sparkSession.createDataFrame([], "series string, lag int, acf double")
    sums = lag_products(centred(seq.series(names)), lag_count(seq.n, max_lags), seq.block_rows).where("kind = 'yy'")
    # the window sees a row per lag and series
    base = F.max(F.when(F.col("lag") == 0, F.col("total"))).over(Window.partitionBy("series"))
    return sums.select("series", "lag", F.try_divide("total", base).alias("acf"))


def acf_and_pacf(seq: Sequence, columns: Seq[str] | None = None, max_lags: int = MAX_LAGS) -> DataFrame:
    """(series, lag, acf, pacf). The partial values follow Yule-Walker with n - k denominators; NULL from the lag on that has none.

    The recursion runs over at most ``max_lags`` + 1 numbers per series; the data pass is the lag sums.
    """
    n = seq.n

    def recursion(key, rows):
        rows = rows.sort_values("lag")
        adjusted = [r * n / (n - k) for r, k in zip(rows["acf"], rows["lag"])]
        out = partial_autocorrelations(adjusted) if rows["acf"].notna().all() else [None] * len(adjusted)
        return rows.assign(pacf=pd.Series(out, index=rows.index, dtype="float64"))

    return acf(seq, columns, max_lags).groupBy("series").applyInPandas(recursion, "series string, lag int, acf double, pacf double")


def pacf(seq: Sequence, columns: Seq[str] | None = None, max_lags: int = MAX_LAGS) -> DataFrame:
    return acf_and_pacf(seq, columns, max_lags).select("series", "lag", "pacf")


def confidence_band(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """One row per usable series: rows and the half-width of the 95 % band."""
    rows = [(c, seq.n, band(seq.n)) for c in _columns(seq, columns)]
    return seq.table.sparkSession.createDataFrame(rows, "series string, n bigint, band double")


def significant_lags(seq: Sequence, columns: Seq[str] | None = None, acf_values: DataFrame | None = None) -> DataFrame:
    """(series, lag, acf) for the reported lags outside the band."""
    values = acf(seq, columns) if acf_values is None else acf_values
    beyond = F.abs(F.round("acf", DECIMALS)) > band(seq.n)
    return values.where(F.col("lag").isin(*REPORTED_LAGS) & beyond)


def lag_pairs(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, pos, y_lag1, y): each value with the one before it."""
    pairs = with_lags(seq.series(_columns(seq, columns)), [1], seq.block_rows)
    return pairs.where(F.col("pos") > 0).select("series", "pos", F.col("lag_1").alias("y_lag1"), "y")


def correlogram(seq: Sequence, columns: Seq[str] | None = None, max_lags: int = MAX_LAGS) -> DataFrame:
    """(series, lag, acf, pacf, band and both significance flags)."""
    both = acf_and_pacf(seq, columns, max_lags)
    limit = band(seq.n)
    return both.select(
        "series", "lag", "acf", "pacf", F.lit(limit).alias("band"),
        (F.abs(F.round("acf", DECIMALS)) > limit).alias("acf_significant"),
        (F.abs(F.round("pacf", DECIMALS)) > limit).alias("pacf_significant"),
    )


def arima_order_hint(seq: Sequence, columns: Seq[str] | None = None, lags: DataFrame | None = None) -> DataFrame:
    """(series, p, q, hint): lengths of the leading runs of significant PACF and ACF lags."""
    table = (correlogram(seq, columns) if lags is None else lags).where("lag >= 1")

    def run(flag: str):
        stop = F.min(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("lag")))
        return F.coalesce(stop - 1, F.max("lag")).cast("int")

    hints = table.groupBy("series").agg(run("pacf_significant").alias("p"), run("acf_significant").alias("q"))
    return hints.withColumn("hint", F.format_string("(%d, d, %d)", "p", "q"))
