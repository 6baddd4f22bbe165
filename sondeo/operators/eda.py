"""Exploratory statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import (
    aggregate_rows, as_double, chunks, col, correlation, is_constant, kurtosis_adjusted, skewness_adjusted, union_all, unpivot,
    variance,
)
from sondeo.operators.profile import Profile, distinct_counts, kept_columns
from sondeo.plans.quantiles import group_sizes, order_statistics, quantiles
from sondeo.plans.ranks import average_ranks, with_ranks
from sondeo.plans.scratch import stored

# List lengths and bin counts of the report.
TOP_SKEWED, TOP_PAIRS, TOP_CARDINALITY = 5, 10, 5
INFORMATION_MIN_ROWS, INFORMATION_BINS = 10, 16
HISTOGRAM_BINS = 30

# Above this many columns, products are summed as matrices instead of one expression per pair.
WIDE_COLUMNS = 64

PAIR_SCHEMA = "a string, b string, ordinal_a int, ordinal_b int, r double"


def _numeric(df: DataFrame, columns, profile: Profile | None) -> list[str]:
    return list(columns) if columns is not None else kept_columns(df, "numeric", profile)


def univariate(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """Moments of every numeric column in one scan."""
    names = _numeric(df, columns, profile)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame(
            [], "column string, ordinal int, n bigint, mean double, std double, min double, max double, skewness double, kurtosis double"
        )
    v = F.col("value")
    found = unpivot(df, {c: as_double(c) for c in names}).groupBy("column").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(variance(v)).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), skewness_adjusted(v).alias("skewness"), kurtosis_adjusted(v).alias("kurtosis"),
    )
    order = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "column string, ordinal int")
    return found.join(F.broadcast(order), "column").select(
        "column", "ordinal", "n", "mean", "std", "min", "max", "skewness", "kurtosis"
    )


def skewness(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    return univariate(df, columns, profile).select("column", "skewness")


def kurtosis(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    return univariate(df, columns, profile).select("column", "kurtosis")


def most_skewed(df: DataFrame, columns=None, profile: Profile | None = None, top: int = TOP_SKEWED) -> DataFrame:
    ranked = univariate(df, columns, profile).where(F.col("skewness").isNotNull())
    return ranked.orderBy(F.abs("skewness").desc(), "ordinal").limit(top).select("column", "skewness", "kurtosis")


def describe(df: DataFrame, columns=None, profile: Profile | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, spread, extremes and quartiles per numeric column. Runs one counting job.

    ``exact=False`` takes the quartiles from one scan of bounded summaries, within 1 / 10,000 of the rows in rank.
    """
    names = _numeric(df, columns, profile)
    moments = univariate(df, names).select("column", "n", "mean", "std", "min", "max")
    if not names:
        return moments.select("*", *[F.lit(None).cast("double").alias(q) for q in ("q25", "q50", "q75")])
    long = unpivot(df, {c: as_double(c) for c in names}).where(F.col("value").isNotNull())
    quartiles = quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], exact)
    named = quartiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return moments.join(F.broadcast(named), "column", "left")


# --- correlation -------------------------------------------------------------------------------------------


def _pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, ordinal_a, ordinal_b, r) for every pair i < j over rows holding both values.

    A first scan finds means, gaps and constant columns. Gap-free columns then need one sum of centred products
    per pair; only pairs with a gap pay for masked moments.
    """
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    stats: list[Row] = []
    for part in chunks(names, 50):
        aggs = [F.struct(F.count(c), F.avg(c), F.min(c).eqNullSafe(F.max(c)), F.count(F.lit(1))) for c in map(as_double, part)]
        stats += df.agg(F.array(*aggs).alias("s")).first()["s"]
    whole = {i: s[1] for i, s in enumerate(stats) if s[0] == s[3] and s[3] and not s[2]}
    flat = {i for i, s in enumerate(stats) if s[2] or not s[0]}
    pairs = list(combinations(range(len(names)), 2))
    frames = []
    clean = [(i, j) for i, j in pairs if i in whole and j in whole]
    if clean:
        frames.append(_centred_pairs(df, names, whole, clean))
    gappy = [(i, j) for i, j in pairs if not (i in whole and j in whole) and i not in flat and j not in flat]
    if gappy:
        frames.append(aggregate_rows(
            df, gappy,
            lambda p: [*_labels(names, *p), correlation(as_double(names[p[0]]), as_double(names[p[1]])).alias("r")], 3,
        ))
    none = [(names[i], names[j], i, j, None) for i, j in pairs if i in flat or j in flat]
    if none:
        frames.append(df.sparkSession.createDataFrame(none, PAIR_SCHEMA))
    return union_all(frames)


def _labels(names: Sequence[str], i: int, j: int) -> list[Column]:
    return [F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.lit(i).alias("ordinal_a"), F.lit(j).alias("ordinal_b")]


def _product_sums(df: DataFrame, names: Sequence[str], means: dict[int, float]) -> DataFrame:
    """(ordinal_a, ordinal_b, s) for all pairs i <= j of many columns: one matrix product per Arrow batch.

    A task adds its batches up and emits its matrix once, so a scan serves any number of pairs.
    """
    held = sorted(means)
    centred = df.select(*[(as_double(names[k]) - F.lit(means[k])).alias(f"c{k}") for k in held])

    def products(batches):
        total = np.zeros((len(held), len(held)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ x
        a, b = np.triu_indices(len(held))
        index = np.array(held, dtype="int32")
        yield pa.RecordBatch.from_arrays([pa.array(index[a]), pa.array(index[b]), pa.array(total[a, b])], ["ordinal_a", "ordinal_b", "s"])

    parts = centred.mapInArrow(products, "ordinal_a int, ordinal_b int, s double")
    label = F.array(*[F.lit(c) for c in names])
    sums = parts.groupBy("ordinal_a", "ordinal_b").agg(F.sum("s").alias("s"))
    return sums.select(label[F.col("ordinal_a")].alias("a"), label[F.col("ordinal_b")].alias("b"), "ordinal_a", "ordinal_b", "s")


def _centred_pairs(df: DataFrame, names: Sequence[str], means: dict[int, float], pairs: list[tuple[int, int]]) -> DataFrame:
    """Correlations of gap-free columns with known means: one sum per pair plus one per column."""

    def build(pair):
        left, right = (as_double(names[k]) - F.lit(means[k]) for k in pair)
        return [*_labels(names, *pair), F.sum(left * right).alias("s")]

    shape = F.col("ordinal_a") == F.col("ordinal_b")
    if len(means) > WIDE_COLUMNS:
        sums = stored(_product_sums(df, names, means), "products")
        squares = sums.where(shape).select(F.col("ordinal_a").alias("k"), F.sqrt("s").alias("root"))  # one per column
        left, right = squares.toDF("ordinal_a", "root_a"), squares.toDF("ordinal_b", "root_b")
        scaled = sums.where(~shape).join(F.broadcast(left), "ordinal_a").join(F.broadcast(right), "ordinal_b")
        r = F.try_divide("s", F.col("root_a") * F.col("root_b"))
        return scaled.select("a", "b", "ordinal_a", "ordinal_b", r.alias("r"))
    sums = aggregate_rows(df, pairs + [(i, i) for i in sorted(means)], build, 1)
    gathered = sums.groupBy().agg(
        F.map_from_entries(F.collect_list(F.when(shape, F.struct("ordinal_a", F.sqrt("s"))))).alias("_scale"),
        F.collect_list(F.when(~shape, F.struct("a", "b", "ordinal_a", "ordinal_b", "s"))).alias("_pairs"),
    )  # a number per pair and column
    spread = gathered.select("_scale", F.inline("_pairs"))
    scale = F.col("_scale")[F.col("ordinal_a")] * F.col("_scale")[F.col("ordinal_b")]
    return spread.select("a", "b", "ordinal_a", "ordinal_b", F.try_divide("s", scale).alias("r"))


def pearson_pairs(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    return _pairs(df, _numeric(df, columns, profile))


def _mirrored(pairs: DataFrame, diagonal: DataFrame) -> DataFrame:
    upper = pairs.select("a", "b", "r")
    both = F.array(F.struct(F.col("a"), F.col("b"), F.col("r")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")))
    return upper.select(F.inline(both)).unionByName(diagonal)


def _diagonal(df: DataFrame, names: Sequence[str]) -> DataFrame:
    def build(name):
        return [F.lit(name).alias("a"), F.lit(name).alias("b"), F.when(~is_constant(as_double(name)), 1.0).alias("r")]

    return aggregate_rows(df, names, build, 1)


def pearson_matrix(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    """Full matrix as (a, b, r); empty under two numeric columns."""
    names = _numeric(df, columns, profile)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return _mirrored(_pairs(df, names), _diagonal(df, names))


def average_rank(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    """(column, value, n, rank): the tie-averaged rank of every distinct value."""
    return average_ranks(df, _numeric(df, columns, profile)).table


def spearman_pairs(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    """Rank correlation of every pair over the rows holding both values.

    Columns without gaps share one ranking; a pair with a gap is ranked again on its own rows. Runs counting
    jobs per ranking.
    """
    names = _numeric(df, columns, profile)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    holes = df.agg(*[F.count_if(as_double(c).isNull()).alias(f"h{i}") for i, c in enumerate(names)]).first()
    whole = [c for i, c in enumerate(names) if holes[i] == 0]
    order = {c: i for i, c in enumerate(names)}
    frames = [_ranked_pairs(df, whole)] if len(whole) >= 2 else []
    for a, b in combinations(names, 2):
        if a not in whole or b not in whole:
            frames.append(_ranked_pairs(df.where(as_double(a).isNotNull() & as_double(b).isNotNull()), [a, b]))
    lookup = F.create_map(*[F.lit(v) for c, i in order.items() for v in (c, i)])
    pairs = union_all(frames)
    return pairs.select("a", "b", lookup[F.col("a")].alias("ordinal_a"), lookup[F.col("b")].alias("ordinal_b"), "r")


def _ranked_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Correlation of average ranks; their mean is (n + 1) / 2, so one pass over the ranked rows is enough."""
    ranked, n = with_ranks(df, names)
    means = {i: (n + 1) / 2 for i in range(len(names))}
    return _centred_pairs(ranked, names, means, list(combinations(range(len(names)), 2)))


def spearman_matrix(df: DataFrame, columns=None, profile: Profile | None = None) -> DataFrame:
    names = _numeric(df, columns, profile)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return _mirrored(spearman_pairs(df, names), _diagonal(df, names))


def top_correlations(df: DataFrame, columns=None, profile: Profile | None = None, top: int = TOP_PAIRS) -> DataFrame:
    """The strongest Pearson pairs, r at three decimals."""
    pairs = pearson_pairs(df, columns, profile)
    best = pairs.orderBy(F.abs("r").desc_nulls_last(), "ordinal_a", "ordinal_b").limit(top)
    r = F.round("r", 3)
    signed = F.when(F.col("r") < 0, -F.abs(r)).otherwise(r)  # round drops the sign of a small negative r
    return best.select("a", "b", signed.alias("r"), "ordinal_a", "ordinal_b")


# --- mutual information ------------------------------------------------------------------------------------


def mutual_information(
    df: DataFrame, columns=None, profile: Profile | None = None, max_columns: int | None = None,
    bins: int = INFORMATION_BINS, top: int | None = TOP_PAIRS,
) -> DataFrame:
    """Plug-in mutual information (nats) of each pair over equal-frequency rank bins.

    A value's bin is floor(bins * share of rows below it), which only needs the bin edges: exact order statistics,
    no ranking of the rows. The counts per pair and bin cell are fixed in number. Runs two small jobs first.
    """
    names = _numeric(df, columns, profile)
    names = names[:max_columns] if columns is None else names  # named columns are never cut
    spark = df.sparkSession
    empty = spark.createDataFrame([], "a string, b string, mi double")
    if len(names) < 2:
        return empty
    held = df.select(*[(as_double(c) + 0.0).alias(c) for c in names])
    held = held.where(reduce(lambda x, y: x & y, [col(c).isNotNull() for c in names]))
    long = unpivot(held, {c: col(c) for c in names})
    sizes = group_sizes(long, ["column"], "value")
    n = sizes.agg(F.max("_n")).first()[0] or 0
    if n < INFORMATION_MIN_ROWS:
        return empty
    edge_ranks = [-(-j * n // bins) - 1 for j in range(1, bins)]  # the ceil(j*n/bins)-th smallest value
    wanted = sizes.select("column", F.explode(F.array(*[F.lit(r).cast("long") for r in sorted(set(edge_ranks))])).alias("_rank"))
    found = order_statistics(long, ["column"], "value", wanted, sizes)
    at = {(r["column"], r["_rank"]): r["_value"] for r in found.collect()}  # columns x bins values

    def bin_of(name: str, low: int = 0, high: int = bins - 1) -> Column:
        # a tree of comparisons: few steps per value, and small enough to compile
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        edge = at[(name, edge_ranks[mid])]
        return F.when(col(name) > edge, bin_of(name, mid + 1, high)).otherwise(bin_of(name, low, mid))

    binned = held.select(*[bin_of(c).alias(f"b{i}") for i, c in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    cells = [F.lit(k * bins * bins) + F.col(f"b{i}") * bins + F.col(f"b{j}") for k, (i, j) in enumerate(pairs)]
    # every task counts its own cells first, so the shuffle is bins x bins rows per pair and task
    counts = binned.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor(F.col("cell") / (bins * bins)).cast("int")
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])[place]
    joint = counts.select(
        sides["i"].alias("i"), sides["j"].alias("j"), F.floor(F.col("cell") % (bins * bins) / bins).alias("x"),
        (F.col("cell") % bins).alias("y"), (F.col("n") / n).alias("p"),
    )
    # bins x bins cells per pair: the marginals are windows over at most 256 rows
    px = F.sum("p").over(Window.partitionBy("i", "j", "x"))
    py = F.sum("p").over(Window.partitionBy("i", "j", "y"))
    terms = joint.select("i", "j", (F.col("p") * F.ln(F.col("p") / (px * py))).alias("term"))
    scores = terms.groupBy("i", "j").agg(F.greatest(F.sum("term"), F.lit(0.0)).alias("mi"))
    label = F.array(*[F.lit(c) for c in names])
    ranked = scores.orderBy(F.col("mi").desc(), "i", "j")
    ranked = ranked.limit(top) if top else ranked
    return ranked.select(label[F.col("i")].alias("a"), label[F.col("j")].alias("b"), "mi")


# --- cardinality and histograms ----------------------------------------------------------------------------


def categorical_cardinality(df: DataFrame, columns=None, profile: Profile | None = None, lowest: int | None = None) -> DataFrame:
    names = list(columns) if columns is not None else kept_columns(df, "categorical", profile)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint")
    counts = distinct_counts(df, names)
    if not lowest:
        return counts
    order = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))
    return counts.orderBy("n_distinct", order).limit(lowest)


def histogram(
    df: DataFrame, columns=None, profile: Profile | None = None, max_columns: int | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins over each column's range, the top edge closed, empty bins
    included. A column with one value puts it all in bin 1."""
    names = _numeric(df, columns, profile)
    names = names[:max_columns] if columns is None else names  # named columns are never cut
    if not names:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n bigint")
    long = unpivot(df, {c: as_double(c) for c in names}).where(F.col("value").isNotNull())

    def build(name):
        c = as_double(name)
        return [F.lit(name).alias("column"), F.min(c).alias("_low"), F.max(c).alias("_high")]

    ranges = aggregate_rows(df, names, build, 2).where(F.col("_low").isNotNull())
    place = F.coalesce(F.width_bucket("value", F.col("_low"), F.col("_high"), F.lit(bins)), F.lit(1))
    held = long.join(F.broadcast(ranges), "column").select("column", F.least(F.lit(bins), place).cast("int").alias("bin"))
    counts = held.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_high") - F.col("_low")) / bins
    grid = ranges.select("column", "_low", "_high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", (F.col("_low") + width * (F.col("bin") - 1)).alias("low"),
        (F.col("_low") + width * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )
