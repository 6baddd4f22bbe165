"""The transforms that the stationarity table recommends, and their inverse.

Transforms are named as there: none, first_difference or detrend, each with an optional `` + log_transform``; seasonal_difference takes
the value ``season`` rows back. Beside the transformed value a row keeps what leads back to the series: the first values of a
difference, the line of a trend. A difference is undone by running sums inside blocks, completed by the sums of the blocks before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import is_constant
from sondeo.plans.sequence import Sequence, block_of, with_lags

LOG = " + log_transform"
STEPS = ("none", "first_difference", "seasonal_difference", "detrend")

EMPTY = "series string, pos bigint, value double, base double"


def _parts(transforms: Mapping[str, str]) -> dict[str, tuple[str, bool]]:
    """Series -> (step, whether the logarithm comes first)."""
    parts = {c: (name.removesuffix(LOG), name.endswith(LOG)) for c, name in transforms.items()}
    for step, _ in parts.values():
        if step not in STEPS:
            raise ValueError(f"no transform is called {step}")
    return parts


def _named(parts: dict[str, tuple[str, bool]], wanted) -> Column:
    return F.col("series").isin([c for c, part in parts.items() if wanted(*part)])


def transformed(seq: Sequence, transforms: Mapping[str, str], season: int = 7) -> DataFrame:
    """(series, pos, value, base): each named series after its transform, gaps filled first.

    ``value`` is NULL in the first rows of a difference, whose own values are in ``base``; for a trend ``base`` is the line. A series
    with a value of zero or less has no logarithm: NULL throughout.
    """
    parts = _parts(transforms)
    if not parts:
        return seq.table.sparkSession.createDataFrame([], EMPTY)
    logged = _named(parts, lambda _, log: log)
    filled = seq.series(list(parts))
    lows = filled.groupBy("series").agg(F.min("y").alias("low"))
    # one row per named series, here and below
    y = F.when(~logged, F.col("y")).when(F.col("low") > 0, F.ln("y"))
    held = filled.join(F.broadcast(lows), "series").select("series", "pos", y.alias("y"))
    frames = []
    for step, back in (("first_difference", 1), ("seasonal_difference", season)):
        if any(s == step for s, _ in parts.values()):
            lagged = with_lags(held.where(_named(parts, lambda s, _, step=step: s == step)), [back], seq.block_rows)
            frames.append(lagged.select("series", "pos", (F.col("y") - F.col(f"lag_{back}")).alias("value"), F.when(F.col("pos") < back, F.col("y")).alias("base")))
    if any(s == "detrend" for s, _ in parts.values()):
        trending = held.where(_named(parts, lambda s, _: s == "detrend"))
        fits = trending.groupBy("series").agg(
            F.avg("y").alias("mean"), F.avg("pos").alias("centre"),
            F.when(is_constant(F.col("y")), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop("pos", "y"), F.var_pop("pos")), F.lit(0.0))).alias("slope"),
        )
        line = F.col("mean") + F.col("slope") * (F.col("pos") - F.col("centre"))
        frames.append(trending.join(F.broadcast(fits), "series").select("series", "pos", (F.col("y") - line).alias("value"), line.alias("base")))
    if any(s == "none" for s, _ in parts.values()):
        frames.append(held.where(_named(parts, lambda s, _: s == "none")).select("series", "pos", F.col("y").alias("value"), F.lit(None).cast("double").alias("base")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def restored(frame: DataFrame, transforms: Mapping[str, str], season: int, block_rows: int) -> DataFrame:
    """(series, pos, y): the inverse of ``transformed``, also of a frame whose values were changed or forecast beyond its end."""
    parts = _parts(transforms)
    back = F.when(_named(parts, lambda s, _: s == "seasonal_difference"), season).otherwise(1)
    differs = _named(parts, lambda s, _: s.endswith("_difference"))
    # a seasonal difference is ``season`` interleaved series, each with its own running sum
    summed = frame.where(differs).select("series", "pos", (F.col("pos") % back).alias("lane"), F.coalesce("base", "value").alias("step")).withColumn("block", block_of(block_rows))
    totals = summed.groupBy("series", "lane", "block").agg(F.sum("step").alias("total"))
    # one row per block, lane and series
    ahead = Window.partitionBy("series", "lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("series", "lane", "block", F.sum("total").over(ahead).alias("carry"))
    upto = Window.partitionBy("series", "lane", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = summed.withColumn("run", F.sum("step").over(upto)).join(carried, ["series", "lane", "block"])
    undone = run.select("series", "pos", (F.col("run") + F.coalesce("carry", F.lit(0.0))).alias("y"))
    plain = frame.where(~differs).select("series", "pos", (F.col("value") + F.coalesce("base", F.lit(0.0))).alias("y"))
    logged = _named(parts, lambda _, log: log)
    return undone.unionByName(plain).select("series", "pos", F.when(logged, F.exp("y")).otherwise(F.col("y")).alias("y"))
