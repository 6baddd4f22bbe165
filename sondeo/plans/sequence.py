"""A table as one long ordered sequence: positions, position blocks with a halo, gap filling, lag products.

No window here runs over the whole sequence. Rows are range-partitioned by time, numbered inside their
partition and shifted by the partition totals; later work is cut into blocks of consecutive positions. Only
tables with one row per partition or block ever see a sequence-wide prefix.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.columns import as_double, col, hashable, kind_of, unpivot
from sondeo.plans.scratch import stored

# Positions per block, and the block count at which blocks grow instead, so block tables stay small.
BLOCK_ROWS = 1 << 17
MAX_BLOCKS = 1 << 20


def tie_break(df: DataFrame, date_column: str) -> list[Column]:
    """A deterministic order for rows of one date: fixed-width columns in table order, then a hash of the rest."""
    fixed, rest = [], []
    for f in df.schema.fields:
        if f.name == date_column:
            continue
        wide = kind_of(f.dataType) == "unsupported" or isinstance(f.dataType, T.StringType)
        (rest if wide else fixed).append(hashable(col(f.name), f.dataType) if wide else col(f.name))
    return fixed + ([F.xxhash64(*rest)] if rest else [])


@dataclass
class Sequence:
    """``table`` holds pos (0-based), ts and one double column per measure, stored in time order."""

    table: DataFrame
    columns: list[str]
    n: int
    present: dict[str, int]  # non-null values per measure
    dropped_null_dates: int
    block_rows: int

    @cached_property
    def _gappy(self) -> DataFrame:
        """Long (series, pos, y) of the series with gaps, filled. Filling shuffles, so its result is stored."""
        gappy = [c for c in self.columns if 0 < self.present[c] < self.n]
        return stored(fill_gaps(long_series(self.table, gappy), self.block_rows), "filled")

    def series(self, columns: Seq[str]) -> DataFrame:
        """Long (series, pos, y) with gaps filled; a series without any value is left out."""
        whole = [c for c in columns if self.present[c] == self.n and self.n]
        gappy = [c for c in columns if 0 < self.present[c] < self.n]
        parts = [long_series(self.table, whole)] if whole else []
        if gappy:
            parts.append(self._gappy.where(F.col("series").isin(gappy)))
        if not parts:
            return self.table.sparkSession.createDataFrame([], "series string, pos bigint, y double")
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]

    def fill(self) -> None:
        """Fill and store the gappy series now, before operators that share them run side by side."""
        if any(0 < self.present[c] < self.n for c in self.columns):
            self._gappy

    @property
    def filled(self) -> DataFrame:
        return self.series(self.columns)

    def raw(self, columns: Seq[str] | None = None) -> DataFrame:
        """Long (series, pos, ts, y) as stored, gaps included."""
        names = self.columns if columns is None else list(columns)
        return long_series(self.table, names, with_time=True)

    def usable(self, min_rows: int, limit: int | None = None) -> list[str]:
        """The first ``limit`` measures that hold a value, given a sequence of at least ``min_rows``."""
        names = self.columns[:limit] if limit else self.columns
        return [c for c in names if self.present[c] and self.n >= min_rows]


def time_order(
    df: DataFrame,
    when: Column,
    measures: Seq[str],
    ties: Seq[Column] = (),
    block_rows: int | None = None,
    partitions: int | None = None,
) -> Sequence:
    """Sort by time, number the rows and keep the narrow result in scratch storage.

    Rows without a date are dropped and counted. ``ties`` orders rows of one date, and a row number those that are equal
    in all of it; the range partitioning uses both, so a date holding a third of the rows is split. Runs two jobs.
    """
    order = ["_ts", *[f"_tie{i}" for i in range(len(ties))], "_row"]
    rows = df.select(
        when.cast("timestamp_ntz").alias("_ts"),
        *[t.alias(f"_tie{i}") for i, t in enumerate(ties)],
        *[as_double(c).alias(f"_m{i}") for i, c in enumerate(measures)],
        F.monotonically_increasing_id().alias("_row"),
    )
    # dateless rows sort last and keep no position; storing them costs one pass less than counting them apart
    keys = [F.col("_ts").asc_nulls_last(), *[F.col(k).asc_nulls_first() for k in order[1:]]]
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    part = F.spark_partition_id()
    numbered = spread.sortWithinPartitions(*keys).select(
        part.alias("part"),
        (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias("place"),
        F.col("_ts").alias("ts"),
        *[F.col(f"_m{i}") for i in range(len(measures))],
    )
    kept = stored(numbered, "sequence")
    sizes = (
        kept.groupBy("part")
        .agg(
            F.count("ts").alias("rows"),
            F.count(F.lit(1)).alias("all"),
            *[F.count(F.when(F.col("ts").isNotNull(), F.col(f"_m{i}"))).alias(f"p{i}") for i in range(len(measures))],
        )
        .orderBy("part").collect()  # one row per shuffle partition
    )
    offsets, n = [], 0
    for s in sizes:
        offsets.append((s["part"], n))
        n += s["rows"]
    present = {c: sum(s[f"p{i}"] for s in sizes) for i, c in enumerate(measures)}
    spark = df.sparkSession
    before = spark.createDataFrame(offsets, "part int, before bigint")
    table = (
        kept.where(F.col("ts").isNotNull())
        .join(F.broadcast(before), "part")
        .select(
            (F.col("before") + F.col("place")).alias("pos"), "ts",
            *[F.col(f"_m{i}").alias(measure_column(c)) for i, c in enumerate(measures)],
        )
    )
    size = block_rows or max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    return Sequence(table, list(measures), n, present, sum(s["all"] for s in sizes) - n, size)


def measure_column(name: str) -> str:
    """The column of a sequence's table that holds a measure; one called like the position or the time gets another name."""
    return f"_measure_{name}" if name.lower() in ("pos", "ts") else name


def long_series(table: DataFrame, columns: Seq[str], with_time: bool = False) -> DataFrame:
    keys = {"pos": F.col("pos")} | ({"ts": F.col("ts")} if with_time else {})
    long = unpivot(table, {c: col(measure_column(c)) for c in columns}, keys, "series", "y")
    return long.select("series", *keys, "y")


def block_of(block_rows: int) -> Column:
    return F.floor(F.col("pos") / F.lit(block_rows)).cast("bigint")


def with_halo(long: DataFrame, halo: int, block_rows: int) -> tuple[DataFrame, int]:
    """Give each block the last ``halo`` rows of the block before it; returns the frame and its block size.

    Rows carry ``block`` and ``own`` (false for halo copies); a block grows if the halo would not fit.
    """
    size = max(block_rows, halo, 1)
    own = block_of(size)
    late = F.col("pos") % size >= size - halo
    homes = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    out = long.withColumn("block", F.explode(homes)) if halo else long.withColumn("block", own)
    return out.withColumn("own", F.col("pos") >= F.col("block") * size), size


def in_block(*order: Column) -> Window:
    return Window.partitionBy("series", "block").orderBy(*(order or (F.col("pos"),)))


def with_lags(long: DataFrame, lags: Seq[int], block_rows: int, value: str = "y") -> DataFrame:
    """Add ``lag_k`` for every k: the value k positions earlier in the same series, NULL at the start."""
    spread, _ = with_halo(long, max(lags), block_rows)
    lagged = spread.select("*", *[F.lag(value, k).over(in_block()).alias(f"lag_{k}") for k in lags])
    return lagged.where("own").drop("own", "block")


def trailing_mean(long: DataFrame, window: int, block_rows: int) -> DataFrame:
    spread, _ = with_halo(long, window - 1, block_rows)
    frame = in_block().rowsBetween(-(window - 1), 0)
    return spread.withColumn("rolling_mean", F.avg("y").over(frame)).where("own").drop("own", "block")


def fill_gaps(long: DataFrame, block_rows: int) -> DataFrame:
    """Linear interpolation by position; leading and trailing gaps take the nearest value."""
    point = F.when(F.col("y").isNotNull(), F.struct("pos", "y"))
    blocks = long.withColumn("block", block_of(block_rows))
    edges = blocks.groupBy("series", "block").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    # one row per block and series: small enough for a prefix per series
    ahead = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("series").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        "series", "block",
        F.last("last", ignorenulls=True).over(ahead).alias("carry_left"),
        F.last("first", ignorenulls=True).over(behind).alias("carry_right"),
    )
    upto = in_block().rowsBetween(Window.unboundedPreceding, 0)
    # the mirrored frame runs forwards too; an unbounded-following frame would rescan the block for every row
    onward = in_block(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = blocks.withColumn("left", F.last(point, ignorenulls=True).over(upto)).withColumn(
        "right", F.last(point, ignorenulls=True).over(onward)
    )
    joined = near.join(carried, ["series", "block"])
    left, right = F.coalesce("left", "carry_left"), F.coalesce("right", "carry_right")
    slope = (right["y"] - left["y"]) / (right["pos"] - left["pos"])
    value = (
        F.when(F.col("y").isNotNull(), F.col("y"))
        .when(left.isNull(), right["y"])
        .when(right.isNull(), left["y"])
        .otherwise(left["y"] + slope * (F.col("pos") - left["pos"]))
    )
    return joined.select("series", "pos", value.alias("y"))


def lag_products(long: DataFrame, max_lag: int, block_rows: int, differences: bool = False) -> DataFrame:
    """(series, kind, lag, total): sums over t of products ``lag`` rows apart, for lag 0..max_lag.

    Kind ``yy`` multiplies y[t] * y[t-lag]; with ``differences`` also ``dd`` (d[t] * d[t-lag]) and ``yd``
    (y[t] * d[t-lag]), where d[t] = y[t] - y[t-1]. Kind ``y`` is the plain sum at lag 0. Blocks are bounded and
    carry their halo, so each task multiplies short arrays; one number per block, kind and lag is shuffled.
    """
    spread, _ = with_halo(long.select("series", "pos", "y"), max_lag + 1, block_rows)
    kinds = ("yy", "dd", "yd") if differences else ("yy",)

    def products(key, rows):
        rows = rows.sort_by("pos")
        y = rows["y"].to_numpy()
        borrowed = len(y) - int(np.count_nonzero(rows["own"].to_numpy()))
        values = {"y": y, "d": np.diff(y, prepend=y[:1])}  # the first row of the sequence has no difference
        first = 1 if borrowed > max_lag else 0  # the halo row that only serves the difference after it
        lags = np.arange(min(max_lag, len(y) - 1 - first) + 1)
        starts = np.maximum(lags + first, borrowed)
        out = [("y", 0, float(y[borrowed:].sum()))]
        for kind in kinds:
            a, b = values[kind[0]], values[kind[1]]
            out += [(kind, int(k), float(a[s:] @ b[s - k : len(b) - k])) for k, s in zip(lags, starts)]
        kind, lag, total = zip(*out)
        series = pa.array([key[0].as_py()] * len(out), pa.string())
        return pa.table({"series": series, "kind": pa.array(kind), "lag": pa.array(lag, pa.int32()), "total": pa.array(total)})

    partial = spread.groupBy("series", "block").applyInArrow(products, "series string, kind string, lag int, total double")
    return partial.groupBy("series", "kind", "lag").agg(F.sum("total").alias("total"))
