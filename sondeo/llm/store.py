"""Intermediate tables in the folder that all executors share, and row numbers without a one-task window."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.plans.scratch import stored

__all__ = ["stored", "numbered", "partitions"]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, column: str, *order) -> DataFrame:
    """``df`` with ``column``, the 0-based rank in ``order``; ties are numbered in any order.

    Rows are range-partitioned, numbered inside their partition and shifted by the totals of the partitions before.
    Only those totals, one for each partition, come to the driver.
    """
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    table = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_inner": inner}),
        "numbered",
    )
    totals = sorted((r["_part"], r["n"]) for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = itertools.accumulate((n for _, n in totals), initial=0)
    shift = {part: at for (part, _), at in zip(totals, before)}
    if not shift:
        return table.withColumn(column, F.lit(0).cast("long")).drop("_part", "_inner")
    starts = F.create_map(*(F.lit(x) for pair in shift.items() for x in pair))
    return table.withColumn(column, (F.element_at(starts, F.col("_part")) + F.col("_inner")).cast("long")).drop("_part", "_inner")
