"""Many ordered sequences in one table: positions, gap filling and lags inside each entity of a panel.

Rows are range-partitioned by entity and time together, so an entity with a third of the rows is split over many tasks while
millions of small ones share one. Each task numbers the rows of an entity as it meets them; only the entity at the
start of a partition may have rows in partitions before, so one carried offset for each partition completes the positions.
Later work is cut into blocks of consecutive positions of one entity, so no window grows with an entity and no lag or gap
reaches over from one entity to the next.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sondeo.functions.columns import as_double, col
from sondeo.plans.scratch import stored
from sondeo.plans.sequence import BLOCK_ROWS, fill_gaps, measure_column

MEASURE = "_measure"


@dataclass
class Panel:
    """``table`` holds the columns of ``by``, pos (0-based within the entity), ts and one double column per measure."""

    table: DataFrame
    by: list[str]
    columns: list[str]
    dropped_null_dates: int
    block_rows: int

    def raw(self, columns: Seq[str] | None = None) -> DataFrame:
        """Long (series, pos, y), gaps included; ``series`` names entity and measure, see ``named``."""
        parts = [
            self.table.select(F.to_json(F.struct(*(col(b) for b in self.by), F.lit(c).alias(MEASURE)), {"ignoreNullFields": "false"}).alias("series"), "pos", col(measure_column(c)).alias("y"))
            for c in (self.columns if columns is None else columns)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def series(self, columns: Seq[str] | None = None) -> DataFrame:
        """Long (series, pos, y) with gaps filled inside each entity; one without any value is left out."""
        return fill_gaps(self.raw(columns), self.block_rows).where(F.col("y").isNotNull())

    def named(self, frame: DataFrame) -> DataFrame:
        """``frame`` with the columns of ``by`` and the measure's name (column) in place of ``series``."""
        fields = [self.table.schema[b] for b in self.by] + [T.StructField(MEASURE, T.StringType())]
        parsed = frame.withColumn("_key", F.from_json("series", T.StructType(fields)))
        rest = [c for c in frame.columns if c != "series"]
        return parsed.select(*(F.col("_key").getField(b).alias(b) for b in self.by), F.col("_key").getField(MEASURE).alias("column"), *rest)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds run (entities met before in this partition) and place (rows of the entity met before in it)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("run", T.LongType()), T.StructField("place", T.LongType())])
    out = to_arrow_schema(schema)

    def number(batches):
        last, run, place = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                values = batch.column(k)
                differ = pc.fill_null(pc.not_equal(values[1:], values[:-1]), False)
                gap = pc.not_equal(values[1:].is_null(), values[:-1].is_null())
                new[1:] |= pc.or_(differ, gap).to_numpy(zero_copy_only=False)
            first = [batch.column(k)[0].as_py() for k in keys]
            new[0] = first != last
            starts = np.flatnonzero(new)
            begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), -place))
            places, runs = np.arange(len(new)) - begun, run + np.cumsum(new)
            last, run, place = [batch.column(k)[-1].as_py() for k in keys], int(runs[-1]), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64()), pa.array(places, pa.int64())], schema=out)

    return rows.mapInArrow(number, schema)


def panel_order(
    df: DataFrame, by: Seq[str], when: Column, measures: Seq[str], ties: Seq[Column] = (),
    block_rows: int = BLOCK_ROWS, partitions: int | None = None,
) -> Panel:
    """Sort each entity by time, number its rows and keep the narrow result in scratch storage.

    A missing entity is one of its own. Rows without a date are dropped and counted. ``ties`` orders rows of one entity and date, and a row
    number those that are equal in all of it. Runs two jobs; one row for each partition comes to the driver.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    order = [*keys, "_ts", *[f"_tie{i}" for i in range(len(ties))], "_row"]
    rows = df.select(
        *[col(b).alias(k) for b, k in zip(by, keys)], when.cast("timestamp_ntz").alias("_ts"), *[t.alias(f"_tie{i}") for i, t in enumerate(ties)],
        *[as_double(c).alias(f"_m{i}") for i, c in enumerate(measures)], F.monotonically_increasing_id().alias("_row"),
    )
    # dateless rows sort last within their entity and keep no position
    sort = [F.col(k).asc_nulls_last() if k == "_ts" else F.col(k).asc_nulls_first() for k in order]
    spread = rows.repartitionByRange(partitions, *sort) if partitions else rows.repartitionByRange(*sort)
    narrow = spread.sortWithinPartitions(*sort).select(F.spark_partition_id().alias("part"), *keys, "_ts", *[f"_m{i}" for i in range(len(measures))])
    kept = stored(_numbered(narrow, keys), "panel")
    edge = F.struct("run", "place", *keys)
    edges = kept.groupBy("part").agg(
        F.min(edge).alias("first"), F.max(edge).alias("last"), F.count(F.lit(1)).alias("rows"), F.count("_ts").alias("dated"),
    ).orderBy("part").collect()  # one row per partition
    carries, carry, before = [], 0, None
    for e in edges:
        entity = tuple(e["first"][k] for k in keys)
        carry = carry if entity == before else 0
        carries.append((e["part"], carry))
        # an entity that fills the whole partition carries on what came before it
        carry = e["last"]["place"] + 1 + (carry if e["last"]["run"] == 0 else 0)
        before = tuple(e["last"][k] for k in keys)
    side = F.broadcast(df.sparkSession.createDataFrame(carries, "part int, carry bigint"))
    offset = F.when(F.col("run") == 0, F.col("carry")).otherwise(0)
    table = kept.where(F.col("_ts").isNotNull()).join(side, "part").select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)], (F.col("place") + offset).alias("pos"), F.col("_ts").alias("ts"),
        *[F.col(f"_m{i}").alias(measure_column(c)) for i, c in enumerate(measures)],
    )
    return Panel(table, list(by), list(measures), sum(e["rows"] - e["dated"] for e in edges), block_rows)
