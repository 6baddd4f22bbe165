"""Average ranks over whole columns: value counts, a range-ordered running count, and a join back."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.columns import as_double, col, unpivot
from sondeo.plans.scratch import stored

# A rank table up to this many values is broadcast; a larger one is joined by shuffle.
BROADCAST_VALUES = 200_000
# A value with a larger share of its column than 1/HOT_SHARE is spread over all join partitions.
HOT_SHARE = 64


@dataclass
class RankTable:
    table: DataFrame  # column, value, n, rank
    rows: dict[str, int]  # non-null values per column
    distinct: dict[str, int]
    hot: dict[str, list[float]]


def average_ranks(df: DataFrame, columns: list[str]) -> RankTable:
    """Rank of every distinct value of every column, ties averaged, NULLs left out.

    Counting first makes a value that fills a third of the column one row. The running count is taken inside
    range partitions and shifted by the totals of the partitions before, so no task sees a whole column.
    """
    long = unpivot(df, {c: as_double(c) + F.lit(0.0) for c in columns}).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    kept = stored(ordered, "ranks")
    totals = (
        kept.groupBy("column", "part")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
        .orderBy("column", "part").collect()  # one row per shuffle partition and column
    )
    rows, seen, distinct = [], {}, {c: 0 for c in columns}
    for t in totals:
        rows.append((t["column"], t["part"], seen.get(t["column"], 0)))
        seen[t["column"]] = seen.get(t["column"], 0) + t["rows"]
        distinct[t["column"]] += t["values"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(rows, "column string, part int, before bigint")
    upto = F.sum("n").over(Window.partitionBy("column", "part").orderBy("value"))
    table = (
        kept.join(F.broadcast(offsets), ["column", "part"])
        .withColumn("rank", F.col("before") + upto - F.col("n") + (F.col("n") + 1) / 2)
        .select("column", "value", "n", "rank")
    )
    hot: dict[str, list[float]] = {c: [] for c in columns}
    large = [c for c in columns if distinct[c] > BROADCAST_VALUES]
    if large:
        is_hot = reduce(
            lambda a, b: a | b,
            [(F.col("column") == c) & (F.col("n") > seen[c] / HOT_SHARE) for c in large],
        )
        for r in kept.where(is_hot).select("column", "value").collect():  # under HOT_SHARE rows per column
            hot[r["column"]].append(r["value"])
    return RankTable(table, {c: seen.get(c, 0) for c in columns}, distinct, hot)


def with_ranks(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Gap-free ``columns`` replaced by their average ranks, and the row count."""
    ranks = average_ranks(df, columns)
    spread = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = df.select(
        *[(as_double(c) + F.lit(0.0)).alias(c) for c in columns],
        # rows that are equal in every column must not share a salt, so it comes from where a row stands
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(spread)).cast("int").alias("_salt"),
    )
    for i, name in enumerate(columns):
        lookup = ranks.table.where(F.col("column") == name).select(
            F.col("value").alias("_value"), F.col("rank").alias(f"_r{i}")
        )
        if ranks.distinct[name] <= BROADCAST_VALUES:
            out = out.join(F.broadcast(lookup), col(name) == F.col("_value"), "left").drop("_value")
        else:
            out = _salted_join(out, name, lookup, ranks.hot[name], spread)
    return out.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)]), max(ranks.rows.values())


def _salted_join(df: DataFrame, name: str, lookup: DataFrame, hot: list[float], spread: int) -> DataFrame:
    if not hot:
        return df.join(lookup, col(name) == F.col("_value"), "left").drop("_value")

    copies = F.when(F.col("_value").isin(hot), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_copy", F.explode(copies))
    left = df.withColumn("_cell", F.when(col(name).isin(hot), F.col("_salt")).otherwise(F.lit(0)))
    on = (col(name) == F.col("_value")) & (F.col("_cell") == F.col("_copy"))
    return left.join(right, on, "left").drop("_value", "_cell", "_copy")
