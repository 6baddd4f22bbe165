"""Order statistics of very large columns without sorting them or holding one in a task.

``percentile`` keeps every distinct value of a group in one buffer. Here a large group is narrowed first: a
counting scan puts its values into a fixed number of bins, a running count over the bins tells which bin holds
each wanted rank and how many values lie below it, and the bin's own smallest and largest value bound the next
scan. When a bin holds few enough rows, only those are counted value by value. Every bound and count is exact;
shuffles carry bin counts and bin contents, never the column.

Sizes, wanted ranks and brackets are tables joined by the group keys, so groups may be as many as the rows. A bracket is
known by its keys and the number of values below it. Groups are never null: rows with a null key are left out.

``approximate_quantiles`` answers from one scan, with a stated error in rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import col
from sondeo.plans.scratch import stored

# Rows of one bracket that are counted value by value, inside one window task.
BRACKET_ROWS = 1 << 17
BINS = 4096
# A round that keeps over half of the rows is followed by one with bins over this many decades.
LOG_DECADES = 1e12
# Brackets up to which their table is broadcast: about a hundred bytes each.
BROADCAST_BRACKETS = 100_000
# An approximate quantile is a value whose rank is off by at most one in this many rows of its group.
ACCURACY = 10_000

BRACKET = ["_n", "_below", "_low", "_high", "_from", "_to", "_log", "_narrowed"]


def rank_positions(n: int, probs: Sequence[float]) -> list[tuple[float, int, float]]:
    """(prob, 0-based rank, share of the next rank) for linear interpolation between closest ranks."""
    out = []
    for p in probs:
        place = (n - 1) * p
        base = min(int(math.floor(place)), n - 1)
        out.append((p, base, place - base))
    return out


def group_sizes(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _n, _low, _high): rows and finite extremes of each group, stored."""
    v = col(value).cast("double")
    finite = F.when(F.abs(v) < math.inf, v)
    sizes = long.where(v.isNotNull()).groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("_low"),
        F.coalesce(F.max(finite), F.lit(0.0)).alias("_high"),
    )
    return stored(sizes, "sizes")


def exact_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
    sizes: DataFrame | None = None, bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """(keys, q0, q1, ...): linearly interpolated quantiles of each group, one column per prob.

    Runs one counting job, and one more per narrowing round while groups lie above ``bracket_rows``.
    """
    sizes = group_sizes(long, keys, value) if sizes is None else sizes
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probs)]))
    place = (F.col("_n") - 1) * F.col("_asked._p")
    placed = sizes.select(*keys, "_n", asked.alias("_asked")).select(*keys, "_n", "_asked._q", place.alias("_place"))
    placed = placed.withColumn("_base", F.least(F.floor("_place"), F.col("_n") - 1))
    share = F.col("_place") - F.col("_base")
    pair = F.array(
        F.struct(F.col("_base").alias("_rank"), (1.0 - share).alias("_weight")),
        F.struct(F.least(F.col("_base") + 1, F.col("_n") - 1).alias("_rank"), share.alias("_weight")),
    )
    # a weight of zero must not meet an infinite value
    weights = placed.select(*keys, "_q", F.inline(pair)).where("_weight > 0")
    values = order_statistics(long, keys, value, weights.select(*keys, "_rank").distinct(), sizes, bracket_rows)
    found = weights.join(values, [*keys, "_rank"]).groupBy(*keys)
    part = F.col("_weight") * F.col("_value")
    return found.agg(*[F.sum(F.when(F.col("_q") == i, part)).alias(f"q{i}") for i in range(len(probs))])


def approximate_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """(keys, q0, q1, ...): values of each group whose rank is within rows / ``accuracy`` of the wanted one.

    One scan: mergeable summaries of a bounded size are built before the shuffle, so a large group is split. The answers
    are values of the group, not interpolated; a group below ``accuracy`` rows gets its exact lower order statistic.
    """
    v = col(value).cast("double")
    keyed = long.where(v.isNotNull() & _keyed(keys)).groupBy(*[col(k) for k in keys])
    summary = keyed.agg(F.percentile_approx(v, [float(p) for p in probs], accuracy).alias("_q"))
    return summary.select(*keys, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probs))])


def quantiles(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], exact: bool = True, sizes: DataFrame | None = None
) -> DataFrame:
    """(keys, q0, q1, ...), exact and interpolated or from one scan within ``ACCURACY``."""
    if exact:
        return exact_quantiles(long, keys, value, probs, sizes)
    return approximate_quantiles(long, keys, value, probs)


def order_statistics(
    long: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, sizes: DataFrame, bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """(keys, _rank, _value): the values at the 0-based ``ranks`` (keys, _rank; distinct) of each group's ascending order.

    Narrowing always ends: bins of equal width part the smallest from the largest value of a bracket, so each such round
    leaves less than 1 / 2048 of its width, and no two rounds in a row use other bins.
    """
    v = (col(value).cast("double") + 0.0).alias("_v")
    long = long.where(col(value).isNotNull()).select(*[col(k) for k in keys], v)
    no = F.lit(False)
    brackets = sizes.select(
        *keys, "_n", F.lit(0).cast("long").alias("_below"), "_low", "_high",
        F.lit(-math.inf).alias("_from"), F.lit(math.inf).alias("_to"), no.alias("_log"), no.alias("_narrowed"),
    ).where(_keyed(keys))
    ended = F.col("_narrowed") & (F.col("_low") == F.col("_high"))
    wide = (F.col("_n") > bracket_rows) & ~ended
    while True:
        count = brackets.agg(F.count(F.lit(1)).alias("all"), F.count_if(wide).alias("wide")).first()
        if not count["wide"]:
            return _pick(long, keys, brackets, ranks, ended, count["all"])
        narrowed = _narrow(long, keys, brackets.where(wide), ranks, count["wide"])
        brackets = stored(brackets.where(~wide).unionByName(narrowed), "brackets")


def _keyed(keys: Sequence[str]) -> Column:
    held = F.lit(True)
    for k in keys:
        held = held & col(k).isNotNull()
    return held


def _beside(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= BROADCAST_BRACKETS else table


def _inside(long: DataFrame, keys: Sequence[str], brackets: DataFrame, count: int) -> DataFrame:
    """The rows of ``long`` that fall into a bracket, tagged with it."""
    return long.join(_beside(brackets, count), list(keys)).where(F.col("_v").between(F.col("_from"), F.col("_to")))


def _bin() -> Column:
    """A bin number that never falls as the value rises; values outside the finite bounds get bins of their own."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    # the width of a bracket may exceed the largest number
    halved = (v / 2 - low / 2) / (high / 2 - low / 2)
    place = F.when(high <= low, 0.0).when(high - low < math.inf, (v - low) / (high - low)).otherwise(halved)
    stretched = F.ln(place * LOG_DECADES + 1.0) / math.log(LOG_DECADES + 1.0)
    share = F.when(F.col("_log"), stretched).otherwise(place)
    inner = F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))
    return F.when(v < low, -1).when(v > high, BINS).otherwise(inner)


def _hits(ranks: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted runs (``_upto`` values up to and including this one) that contain a wanted rank."""
    start = F.col("_upto") - F.col("_n")
    return counted.join(ranks, list(keys)).where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_upto")))


def _narrow(long: DataFrame, keys: Sequence[str], brackets: DataFrame, ranks: DataFrame, count: int) -> DataFrame:
    tag = [*keys, "_below"]
    kept = brackets.withColumnRenamed("_n", "_all")
    binned = _inside(long, keys, kept, count).select(*tag, "_all", "_log", "_v", _bin().alias("_bin"))
    counts = binned.groupBy(*tag, "_all", "_log", "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    running = F.sum("_n").over(Window.partitionBy(*tag).orderBy("_bin"))  # at most BINS + 2 rows
    counts = counts.withColumn("_upto", running + F.col("_below"))
    found = _hits(ranks, counts, keys).select(
        *keys, "_n", (F.col("_upto") - F.col("_n")).alias("_below"), "_low", "_high", F.col("_low").alias("_from"), F.col("_high").alias("_to"),
        ((F.col("_n") > F.col("_all") / 2) & ~F.col("_log")).alias("_log"), F.lit(True).alias("_narrowed"),
    )
    return found.distinct()


def _pick(long: DataFrame, keys: Sequence[str], brackets: DataFrame, ranks: DataFrame, ended: Column, count: int) -> DataFrame:
    """Count the bracket contents value by value and read off the wanted ranks."""
    tag = [*keys, "_below"]
    counted = _inside(long, keys, brackets.where(~ended), count).groupBy(*tag, "_v").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*tag).orderBy("_v"))
    counted = counted.withColumn("_upto", running + F.col("_below"))
    single = brackets.where(ended).select(*tag, F.col("_low").alias("_v"), "_n", (F.col("_below") + F.col("_n")).alias("_upto"))
    return _hits(ranks, counted.unionByName(single), keys).select(*keys, "_rank", F.col("_v").alias("_value"))
