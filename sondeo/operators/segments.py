"""Segment comparison: statistics per category value and one-way analysis of variance."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import as_double, as_text, unpivot, variance
from sondeo.functions.tails import f_p_value
from sondeo.operators.profile import Profile, distinct_counts, kept_columns, screen_distinct
from sondeo.plans.quantiles import quantiles

# Category limits, list length.
MIN_CATEGORIES, MAX_CATEGORIES = 2, 20
TOP_SEGMENTS = 5


def usable_segments(
    df: DataFrame, columns: Seq[str] | None = None, profile: Profile | None = None, limit: int | None = None
) -> DataFrame:
    """(ordinal, column, n_distinct) of categoricals with 2 to 20 distinct values; ``limit`` keeps the first ones.

    A sketch rules out the large ones first, so only small columns are counted exactly. Runs one job.
    """
    names = list(columns) if columns is not None else kept_columns(df, "categorical", profile)
    _, estimates = screen_distinct(df, names) if names else (0, {})
    small = [c for c in names if estimates[c] <= 2 * MAX_CATEGORIES]
    spark = df.sparkSession
    if not small:
        return spark.createDataFrame([], "ordinal int, column string, n_distinct bigint")
    order = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "ordinal int, column string")
    fits = distinct_counts(df, small).where(F.col("n_distinct").between(MIN_CATEGORIES, MAX_CATEGORIES))
    ranked = fits.join(F.broadcast(order), "column").orderBy("ordinal").select("ordinal", "column", "n_distinct")
    return ranked.limit(limit) if limit else ranked


def segment_names(
    df: DataFrame, columns: Seq[str] | None = None, profile: Profile | None = None, limit: int | None = None
) -> list[str]:
    return [r["column"] for r in usable_segments(df, columns, profile, limit).collect()]


def _long(df: DataFrame, groupings: Seq[str], measures: Seq[str]) -> DataFrame:
    """(cat_col, cat, m0, m1, ...): a row per input row and grouping column, missing categories dropped."""
    keys = {f"m{i}": as_double(c) for i, c in enumerate(measures)}
    long = unpivot(df, {c: as_text(df, c) for c in groupings}, keys, "cat_col", "cat")
    return long.where(F.col("cat").isNotNull())


def segment_moments(df: DataFrame, groupings: Seq[str], measures: Seq[str]) -> DataFrame:
    """(cat_col, cat, num_col, num_ordinal, mean, std, n): one shuffle of partial sums for all pairs."""
    long = _long(df, groupings, measures)
    aggs = []
    for i, c in enumerate(measures):
        y = F.col(f"m{i}")
        aggs.append(F.struct(
            F.lit(c).alias("num_col"), F.lit(i).alias("num_ordinal"), F.avg(y).alias("mean"),
            F.sqrt(variance(y)).alias("std"), F.count(y).alias("n"),
        ))
    wide = long.groupBy("cat_col", "cat").agg(F.array(*aggs).alias("_m"))
    return wide.select("cat_col", "cat", F.inline("_m"))


def segment_stats(df: DataFrame, groupings: Seq[str], measures: Seq[str], exact: bool = True) -> DataFrame:
    """(cat_col, cat, num_col, mean, std, n, median) of every measure per category value.

    Runs the quantile jobs. ``groupings`` usually come from ``usable_segments``, but may be keys of any number of values.
    ``exact=False`` takes the medians from one scan of bounded summaries, within 1 / 10,000 of a segment's rows in rank.
    """
    measures = list(measures)
    if not groupings or not measures:
        return df.sparkSession.createDataFrame(
            [], "cat_col string, cat string, num_col string, mean double, std double, n bigint, median double"
        )
    moments = segment_moments(df, groupings, measures)
    long = _long(df, groupings, measures)
    values = unpivot(
        long, {c: F.col(f"m{i}") for i, c in enumerate(measures)}, {"cat_col": F.col("cat_col"), "cat": F.col("cat")}, "num_col", "y"
    )
    keys = ["cat_col", "cat", "num_col"]
    medians = quantiles(values, keys, "y", [0.5], exact).select(*keys, F.col("q0").alias("median"))
    return moments.join(medians, keys, "left").select(*keys, "mean", "std", "n", "median")


def anova(df: DataFrame, groupings: Seq[str], measures: Seq[str], moments: DataFrame | None = None) -> DataFrame:
    """(cat_col, num_col, groups, f_stat, p_value, degenerate) from the group moments alone."""
    measures = list(measures)
    if not groupings or not measures:
        return df.sparkSession.createDataFrame(
            [], "cat_col string, num_col string, df1 bigint, df2 bigint, f_stat double, p_value double, degenerate boolean"
        )
    cells = (segment_moments(df, groupings, measures) if moments is None else moments).where(F.col("n") >= 2)
    within = F.sum((F.col("n") - 1) * F.col("std") * F.col("std"))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum(F.col("n") * F.col("mean")) * F.sum(
        F.col("n") * F.col("mean")) / F.sum("n")
    # deviations from a common centre keep the between-group sum free of cancellation
    centre = F.avg("mean").over(Window.partitionBy("cat_col", "num_col"))
    pairs = (
        cells.withColumn("mean", F.col("mean") - centre).groupBy("cat_col", "num_col")
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), within.alias("ssw"), between.alias("ssb"))
        .where(F.col("groups") >= 2)
        .withColumn("df1", F.col("groups") - 1).withColumn("df2", F.col("rows") - F.col("groups"))
    )
    f = F.try_divide(F.col("ssb") / F.col("df1"), F.col("ssw") / F.col("df2"))
    scored = pairs.withColumn("f_stat", f)
    p = f_p_value(F.col("f_stat"), F.col("df1").cast("double"), F.col("df2").cast("double"))
    return scored.select("cat_col", "num_col", "df1", "df2", "f_stat", p.alias("p_value"), (F.col("ssw") == 0).alias("degenerate"))


def top_grouping(df: DataFrame, groupings: Seq[str], measures: Seq[str], anova_table: DataFrame | None = None) -> DataFrame:
    """One row: the grouping column with the largest F over all measures; none if no F is above zero."""
    measures = list(measures)
    table = anova(df, groupings, measures) if anova_table is None else anova_table
    cat_order = F.array_position(F.array(*[F.lit(c) for c in groupings]).cast("array<string>"), F.col("cat_col"))
    num_order = F.array_position(F.array(*[F.lit(c) for c in measures]).cast("array<string>"), F.col("num_col"))
    best = table.where(F.col("f_stat") > 0).orderBy(F.col("f_stat").desc(), cat_order, num_order).limit(1)
    return best.select(F.col("cat_col").alias("top_grouping"), "f_stat")


def segment_mean_bars(df: DataFrame, grouping: str, measure: str) -> DataFrame:
    """(cat, mean, n) of one measure per value of one grouping column."""
    return segment_moments(df, [grouping], [measure]).select("cat", "mean", "n")


def top_bottom_segments(df: DataFrame, grouping: str, measure: str, k: int = TOP_SEGMENTS) -> DataFrame:
    """(side, place, cat, mean, n): the k highest and k lowest means; the lists overlap for few segments."""
    bars = segment_mean_bars(df, grouping, measure)
    # at most 20 rows, one per segment
    one = Window.partitionBy(F.lit(1))
    down = F.row_number().over(one.orderBy(F.col("mean").desc_nulls_last(), "cat"))
    up = F.row_number().over(one.orderBy(F.col("mean").asc_nulls_last(), F.col("cat").desc()))
    ranked = bars.select("cat", "mean", "n", down.alias("down"), up.alias("up"))
    top = ranked.where(F.col("down") <= k).select(F.lit("top").alias("side"), F.col("down").alias("place"), "cat", "mean", "n")
    low = ranked.where(F.col("up") <= k).select(F.lit("bottom").alias("side"), F.col("up").alias("place"), "cat", "mean", "n")
    return top.unionByName(low)
