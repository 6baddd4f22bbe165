"""Shift of distributions between a reference and a current part of a table.

Values are counted by side before anything moves, so one that fills a third of a column is one row. The counts are
range-partitioned by column and value; running counts inside each partition, completed by the totals of those before, give both
distribution functions at every value, and with them their largest distance and the shares of equal-frequency bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import as_double, as_text, unpivot
from sondeo.plans.scratch import stored

# Usual bins and limits of the stability index, and what an empty bin counts as.
BINS = 10
MODERATE, LARGE = 0.1, 0.25
EMPTY = 0.5

NUMERIC = "column string, n_reference bigint, n_current bigint, ks double, p_value double, psi double, shift string"
CATEGORY = "column string, n_reference bigint, n_current bigint, n_categories bigint, psi double, total_variation double, shift string"


def _counted(df: DataFrame, is_current: Column, values: dict[str, Column]) -> DataFrame:
    """(column, value, r, c): rows of each value in the reference and the current part; a NULL side or value is in neither."""
    long = unpivot(df, values, {"side": is_current}).where(F.col("side").isNotNull() & F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count_if(~F.col("side")).alias("r"), F.count_if(F.col("side")).alias("c"))


def _share(n: Column, rows: Column, bins: Column) -> Column:
    return F.greatest(n, F.lit(EMPTY)) / F.greatest(rows, bins * EMPTY)


def _index(r: Column, c: Column, rows_r: Column, rows_c: Column, bins: Column) -> Column:
    """What one bin adds; one that is empty on both sides adds nothing, on one side it counts as half a row."""
    before, now = _share(r, rows_r, bins), _share(c, rows_c, bins)
    return F.when((r > 0) | (c > 0), (now - before) * F.ln(now / before)).otherwise(0.0)


def _shift(psi: Column) -> Column:
    return F.when(psi >= LARGE, "large").when(psi >= MODERATE, "moderate").when(psi.isNotNull(), "stable")


def kolmogorov_tail(distance: Column, effective: Column) -> Column:
    """Asymptotic p of the two-sample statistic with the usual correction for small samples."""
    root = F.sqrt(effective)
    scaled = (root + 0.12 + 0.11 / root) * distance
    terms = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled))
    tail = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    # the alternating sum is 1 to nine digits below, and converges within its terms above
    return F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def numeric_drift(df: DataFrame, is_current: Column, columns: Sequence[str], bins: int = BINS) -> DataFrame:
    """(column, n_reference, n_current, ks, p_value, psi, shift) of every numeric column that holds a value on a side.

    Bins hold equal shares of the reference: a value's bin is floor(bins * share of reference rows below it). Statistics are NULL where a
    side has no values. Runs two jobs.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], NUMERIC)
    # negative zero is zero; NaN is missing
    values = {c: F.when(~F.isnan(as_double(c)), as_double(c) + F.lit(0.0)) for c in columns}
    ordered = _counted(df, is_current, values).repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    kept = stored(ordered, "drift")
    totals = kept.groupBy("column", "part").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).orderBy("column", "part").collect()  # one row per shuffle partition and column
    seen, offsets = {}, []
    for t in totals:
        r, c = seen.get(t["column"], (0, 0))
        offsets.append((t["column"], t["part"], r, c))
        seen[t["column"]] = (r + t["r"], c + t["c"])
    if not offsets:
        return spark.createDataFrame([], NUMERIC)
    side = spark.createDataFrame([(*o, *seen[o[0]]) for o in offsets], "column string, part int, before_r bigint, before_c bigint, rows_r bigint, rows_c bigint")
    upto = Window.partitionBy("column", "part").orderBy("value")
    run = kept.join(F.broadcast(side), ["column", "part"]).select(
        "column", "r", "c", "rows_r", "rows_c", (F.col("before_r") + F.sum("r").over(upto)).alias("upto_r"), (F.col("before_c") + F.sum("c").over(upto)).alias("upto_c"),
    )
    place = F.least(F.lit(bins - 1), F.expr(f"try_divide({bins} * (upto_r - r), rows_r)").cast("int"))
    apart = F.abs(F.try_divide("upto_r", "rows_r") - F.try_divide("upto_c", "rows_c"))
    placed = run.select("*", place.alias("bin"), apart.alias("apart"))
    found = placed.groupBy("column").agg(
        F.first("rows_r").alias("n_reference"), F.first("rows_c").alias("n_current"), F.max("apart").alias("ks"),
        F.array(*(F.struct(F.sum(F.when(F.col("bin") == b, F.col("r")).otherwise(0)).alias("r"), F.sum(F.when(F.col("bin") == b, F.col("c")).otherwise(0)).alias("c")) for b in range(bins))).alias("cells"),
    )
    n_r, n_c = F.col("n_reference"), F.col("n_current")
    both = (n_r > 0) & (n_c > 0)
    psi = F.aggregate("cells", F.lit(0.0), lambda total, cell: total + _index(cell["r"], cell["c"], n_r, n_c, F.lit(bins)))
    judged = found.select("column", "n_reference", "n_current", F.when(both, F.col("ks")).alias("ks"), F.when(both, psi).alias("psi"))
    p = F.when(both, kolmogorov_tail(F.col("ks"), n_r * F.lit(1.0) * n_c / (n_r + n_c)))
    return judged.select("column", "n_reference", "n_current", "ks", p.alias("p_value"), "psi", _shift(F.col("psi")).alias("shift"))


def category_drift(df: DataFrame, is_current: Column, columns: Sequence[str]) -> DataFrame:
    """(column, n_reference, n_current, n_categories, psi, total_variation, shift) of every categorical column that holds a value on a side."""
    if not columns:
        return df.sparkSession.createDataFrame([], CATEGORY)
    counts = stored(_counted(df, is_current, {c: as_text(df, c) for c in columns}), "drift")
    sizes = counts.groupBy("column").agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"), F.count(F.lit(1)).alias("n_categories"))
    n_r, n_c = F.col("n_reference"), F.col("n_current")
    # one row per column of the table
    beside = counts.join(F.broadcast(sizes), "column").where((n_r > 0) & (n_c > 0))
    scores = beside.groupBy("column").agg(
        F.sum(_index(F.col("r"), F.col("c"), n_r, n_c, F.col("n_categories"))).alias("psi"), (F.sum(F.abs(F.col("r") / n_r - F.col("c") / n_c)) / 2).alias("total_variation"),
    )
    return sizes.join(F.broadcast(scores), "column", "left").select("column", "n_reference", "n_current", "n_categories", "psi", "total_variation", _shift(F.col("psi")).alias("shift"))
