"""Calendar means, correlation at seasonal lags and calendar box statistics."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.columns import correlation, unpivot
from sondeo.plans.quantiles import quantiles
from sondeo.plans.sequence import Sequence, with_lags

# Lags in rows, class limits, labels.
SEASONAL_LAGS = (("weekly", 7), ("monthly", 12), ("quarterly", 4))
SEASONAL, WEAK = 0.30, 0.15
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WHISKER = 1.5


def _columns(seq: Sequence, columns: Seq[str] | None) -> list[str]:
    return list(columns) if columns is not None else seq.usable(1)


def _month() -> tuple[Column, Column]:
    number = F.month("ts")
    return number, F.array(*[F.lit(m) for m in MONTHS])[number - 1]


def _weekday() -> tuple[Column, Column]:
    number = F.weekday("ts")  # Monday is 0
    return number, F.array(*[F.lit(d) for d in WEEKDAYS])[number]


def _calendar_means(seq: Sequence, columns: Seq[str] | None, period: tuple[Column, Column]) -> DataFrame:
    number, label = period
    names = _columns(seq, columns)
    rows = seq.raw(names).select("series", number.alias("period"), label.alias("label"), "y")
    means = rows.groupBy("series", "period", "label").agg(F.avg("y").alias("mean"))
    return means.where(F.col("mean").isNotNull())


def month_means(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, period 1-12, label, mean) of the raw values by calendar month."""
    return _calendar_means(seq, columns, _month())


def weekday_means(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, period 0-6 from Monday, label, mean) of the raw values by weekday."""
    return _calendar_means(seq, columns, _weekday())


def lag_correlation(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, lag_name, lag, r): correlation of the filled series with itself k rows earlier; 0 where undefined."""
    wide = _lag_correlations(seq, columns)
    rs = {name: F.col(name) for name, _ in SEASONAL_LAGS}
    long = unpivot(wide, rs, {"series": F.col("series")}, "lag_name", "r")
    lag = F.create_map(*[F.lit(v) for pair in SEASONAL_LAGS for v in pair])[F.col("lag_name")]
    return long.select("series", "lag_name", lag.alias("lag"), "r")


def _lag_correlations(seq: Sequence, columns: Seq[str] | None) -> DataFrame:
    names = _columns(seq, columns)
    lags = [k for _, k in SEASONAL_LAGS if seq.n > k + 1]
    series = seq.series(names)
    lagged = with_lags(series, lags, seq.block_rows) if lags else series
    rs = [
        (F.coalesce(correlation(F.col("y"), F.col(f"lag_{k}")), F.lit(0.0)) if k in lags else F.first(F.lit(0.0))).alias(name)
        for name, k in SEASONAL_LAGS
    ]
    return lagged.groupBy("series").agg(*rs)


def seasonal_class(seq: Sequence, columns: Seq[str] | None = None) -> DataFrame:
    """(series, max_abs_r, seasonal_class)."""
    peak = F.greatest(*[F.abs(name) for name, _ in SEASONAL_LAGS])
    scored = _lag_correlations(seq, columns).select("series", peak.alias("max_abs_r"))
    label = F.when(F.round("max_abs_r", 4) >= SEASONAL, "seasonal").when(F.round("max_abs_r", 4) >= WEAK, "weakly_seasonal")
    return scored.withColumn("seasonal_class", label.otherwise("not_seasonal"))


def calendar_box_stats(seq: Sequence, columns: Seq[str] | None = None, exact: bool = True) -> DataFrame:
    """Box statistics by month and by weekday for every seasonal series (or the given ones).

    Columns: series, grain, period, label, n, low, q1, median, q3, high, whisker_low, whisker_high. The whisker is
    the furthest value within 1.5 IQR of the box. Runs the quantile jobs; ``exact=False`` answers them from one scan.
    """
    if columns is None:
        found = {r["series"] for r in seasonal_class(seq).where("seasonal_class <> 'not_seasonal'").collect()}
        columns = [c for c in seq.columns if c in found]
    columns = list(columns)
    schema = "series string, grain string, period int, label string, n bigint, low double, q1 double, median double," \
             " q3 double, high double, whisker_low double, whisker_high double"
    if not columns:
        return seq.table.sparkSession.createDataFrame([], schema)
    cells = F.array(*[
        F.struct(F.lit(grain).alias("grain"), number.alias("period"), label.alias("label"))
        for grain, (number, label) in (("month", _month()), ("weekday", _weekday()))
    ])
    long = seq.raw(columns).where(F.col("y").isNotNull()).select("series", "y", F.inline(cells))
    keys = ["series", "grain", "period"]
    box = quantiles(long, keys, "y", [0.25, 0.5, 0.75], exact)
    named = box.select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    held = long.join(F.broadcast(named), keys)  # at most 19 boxes per series
    inside = F.when(F.col("y").between(F.col("q1") - reach, F.col("q3") + reach), F.col("y"))
    return held.groupBy(*keys, "label", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"),
        F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
    ).select(*[c.split()[0] for c in schema.split(", ")])
