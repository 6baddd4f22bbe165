"""Baseline forecasts, their evaluation over many origins, and error measures.

All methods use what lies at or before the origin only, so gaps are never filled from later values: the naive forecast is the
last present value, the moving average takes the values present in its window, the line is fitted to present values. Every
row works out in one pass what an origin there would know: running sums of (1, t, tt, y, ty) inside its block, completed by the
totals of the blocks before. A sliding fit is the difference of two such rows. Row and origins then meet in one shuffle by
(series, origin), a few rows each, so many origins cost one scan.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.plans.panel import Panel
from sondeo.plans.sequence import Sequence, in_block, with_halo

METHODS = ("naive", "seasonal_naive", "moving_average", "linear")
SUMS = ("n", "t", "tt", "y", "ty")


def _known(seq: Sequence | Panel, columns: Seq[str] | None, window: int, lags: Seq[int]) -> DataFrame:
    """(series, pos, y, length, centre, mean, lags, naive, moving_average, sum_*) of every row.

    Sums run over the present values up to the row, times counted from ``centre`` and values from ``mean``, which keeps digits.
    """
    raw = seq.raw(columns).select("series", "pos", "y")
    sizes = raw.groupBy("series").agg((F.max("pos") + 1).alias("length"), F.avg("y").alias("mean")).withColumn("centre", F.floor(F.col("length") / 2).cast("double"))
    # one row per measure of a sequence; a panel has one per entity, which adaptive execution joins as its size allows
    long = raw.join(F.broadcast(sizes) if isinstance(seq, Sequence) else sizes, "series")
    spread, _ = with_halo(long, max(window - 1, *lags), seq.block_rows)
    t, y, there = F.col("pos") - F.col("centre"), F.col("y") - F.col("mean"), F.col("y").isNotNull()
    terms = {"n": F.lit(1.0), "t": t, "tt": t * t, "y": y, "ty": t * y}
    own = spread.withColumns({f"term_{k}": F.when(there & F.col("own"), v) for k, v in terms.items()})
    point = F.when(there, F.struct("pos", "y"))
    blocks = own.where("own").groupBy("series", "block").agg(*(F.coalesce(F.sum(f"term_{k}"), F.lit(0.0)).alias(f"block_{k}") for k in SUMS), F.max(point).alias("point"))
    # one row per block and series
    ahead = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("series", "block", *(F.coalesce(F.sum(f"block_{k}").over(ahead), F.lit(0.0)).alias(f"carry_{k}") for k in SUMS), F.max("point").over(ahead).alias("carry_point"))
    upto = in_block().rowsBetween(Window.unboundedPreceding, 0)
    near = own.select(
        "series", "block", "own", "pos", "y", "length", "centre", "mean", F.array(*(F.lag("y", k).over(in_block()) for k in lags)).alias("lags"),
        F.avg("y").over(in_block().rowsBetween(-(window - 1), 0)).alias("moving_average"), F.last(point, ignorenulls=True).over(upto).alias("last"),
        *(F.coalesce(F.sum(f"term_{k}").over(upto), F.lit(0.0)).alias(f"run_{k}") for k in SUMS),
    ).where("own")
    return near.join(carried, ["series", "block"]).select(
        "series", "pos", "y", "length", "centre", "mean", "lags", F.coalesce("last", "carry_point")["y"].alias("naive"), "moving_average",
        *((F.col(f"run_{k}") + F.col(f"carry_{k}")).alias(f"sum_{k}") for k in SUMS),
    )


def _line(at: Column) -> Column:
    """The fitted line at position ``at``; NULL under two present values."""
    n, t, tt, y, ty = (F.col(f"sum_{k}") for k in SUMS)
    slope = F.try_divide(n * ty - t * y, n * tt - t * t)
    return F.when(n >= 2, F.col("mean") + y / n + slope * (at - F.col("centre") - t / n))


def _season_lags(season: int, horizon: int) -> list[int]:
    return [season * k for k in range(1, -(-horizon // season) + 1)]


def _check(**sizes: int | None) -> None:
    for name, size in sizes.items():
        if size is not None and size < 1:
            raise ValueError(f"{name} must be at least 1")


def _named(seq: Sequence | Panel, frame: DataFrame) -> DataFrame:
    return seq.named(frame) if isinstance(seq, Panel) else frame


def rolling_origin(
    seq: Sequence | Panel, horizon: int, every: int = 1, first: int | None = None, season: int = 7, window: int = 7, train_rows: int | None = None,
    columns: Seq[str] | None = None,
) -> DataFrame:
    """(series, origin, step, pos, actual, naive, seasonal_naive, moving_average, linear): forecasts 1 to ``horizon`` rows ahead.

    Origins are the positions ``first``, ``first`` + ``every`` and so on; ``first`` is the larger of ``season`` and ``window`` unless
    given. The line is fitted to all rows up to the origin, or to the last ``train_rows``. Missing actual values give no row; a forecast
    that nothing is known for is NULL. For a panel, the columns of ``by`` and the measure stand in place of ``series``.
    """
    _check(horizon=horizon, every=every, season=season, window=window, train_rows=train_rows)
    first = max(season, window) if first is None else first
    rows = _known(seq, columns, window, _season_lags(season, horizon))
    # an origin at this row, and the end of what a later origin leaves out
    fits = [F.struct(F.col("pos").alias("origin"), F.lit(0).alias("step"), F.lit(1.0).alias("sign"))]
    if train_rows:
        fits.append(F.struct((F.col("pos") + train_rows).alias("origin"), F.lit(0).alias("step"), F.lit(-1.0).alias("sign")))
    is_origin = lambda p: (p["origin"] >= first) & ((p["origin"] - first) % every == 0) & (p["origin"] < F.col("length") - 1)
    earliest = F.greatest(F.ceil((F.col("pos") - horizon - first) / every), F.lit(0))
    latest = F.floor((F.col("pos") - 1 - first) / every)
    met = F.when(F.col("y").isNotNull() & (latest >= earliest), F.transform(F.sequence(earliest, latest), lambda k: F.struct(
        (k * every + first).cast("bigint").alias("origin"), (F.col("pos") - k * every - first).cast("int").alias("step"), F.lit(None).cast("double").alias("sign"),
    )))
    parts = rows.withColumn("part", F.explode(F.concat(F.filter(F.array(*fits), is_origin), F.coalesce(met, F.expr("array()").cast("array<struct<origin:bigint,step:int,sign:double>>")))))
    fit = F.col("part.step") == 0
    ahead = F.col("part.step") > 0
    flat = parts.select(
        "series", F.col("part.origin").alias("origin"), F.col("part.step").alias("step"), "centre", "mean", F.when(ahead, F.col("pos")).alias("pos"), F.when(ahead, F.col("y")).alias("actual"),
        F.when(ahead, F.element_at("lags", F.ceil(F.col("part.step") / season).cast("int"))).alias("seasonal_naive"),
        *(F.when(F.col("part.sign") > 0, F.col(c)).alias(c) for c in ("naive", "moving_average")), *(F.when(fit, F.col("part.sign") * F.col(f"sum_{k}")).alias(f"sum_{k}") for k in SUMS),
    )
    # horizon + 2 rows at most
    together = Window.partitionBy("series", "origin")
    joined = flat.withColumns(
        {c: F.max(c).over(together) for c in ("naive", "moving_average")} | {f"sum_{k}": F.sum(f"sum_{k}").over(together) for k in SUMS}
    ).where(F.col("step") > 0)
    return _named(seq, joined.select("series", "origin", "step", "pos", "actual", "naive", "seasonal_naive", "moving_average", _line(F.col("pos")).alias("linear")))


def baseline_forecast(seq: Sequence | Panel, horizon: int, season: int = 7, window: int = 7, columns: Seq[str] | None = None) -> DataFrame:
    """(series, step, pos, naive, seasonal_naive, moving_average, linear) for the ``horizon`` rows after the end of every series."""
    _check(horizon=horizon, season=season, window=window)
    rows = _known(seq, columns, window, [1])
    # a row of the last season serves the steps that fall on its place; the last row knows the rest
    tail = rows.where(F.col("pos") >= F.col("length") - season)
    place = (F.col("pos") - F.col("length") + season + 1).cast("int")
    steps = F.when(place <= horizon, F.sequence(place, F.lit(horizon), F.lit(season)))
    end = F.col("pos") == F.col("length") - 1
    seasonal = tail.where(steps.isNotNull()).select("series", F.explode(steps).alias("step"), F.col("y").alias("seasonal_naive"))
    last = rows.where(end).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("pos", F.col("pos") + F.col("step"))
    found = last.join(seasonal, ["series", "step"], "left")
    return _named(seq, found.select("series", "step", "pos", "naive", "seasonal_naive", "moving_average", _line(F.col("pos")).alias("linear")))


def forecast_errors(forecasts: DataFrame, by: Seq[str] = ("series",), methods: Seq[str] = METHODS) -> DataFrame:
    """(by, method, n, bias, mae, rmse, mape, n_zero) from ``actual`` and one column per method; bias is forecast less actual.

    ``mape`` leaves out actual values of zero, which ``n_zero`` counts; NULL if nothing is left. One aggregate, summed in every task first.
    """
    actual = F.col("actual")

    def measures(method: str) -> Column:
        both = F.col(method).isNotNull() & actual.isNotNull()
        off = F.when(both, F.col(method) - actual)
        share = F.when(actual != 0, F.abs(off) / F.abs(actual))
        return F.struct(
            F.lit(method).alias("method"), F.count(off).alias("n"), F.avg(off).alias("bias"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"),
            (100 * F.avg(share)).alias("mape"), F.count(F.when(both & (actual == 0), 1)).alias("n_zero"),
        )

    return forecasts.groupBy(*by).agg(F.array(*(measures(m) for m in methods)).alias("each")).select(*by, F.inline("each"))
