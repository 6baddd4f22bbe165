"""Profile and quality of a stream in event-time windows, with an exact count of rows that came too late.

Two streaming queries read the same source. One keeps mergeable moments for each window as state, closes a window once the watermark
has passed its end and appends its final values as Parquet. The other is stateless and reads the time column only: each
task counts the rows it met by window. What arrived for a closed window and is not in its values came too late.
Both go on from their own checkpoints after a failure, and the file sink lists each batch once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sondeo.functions.columns import as_double, col, hashable, is_constant, kind_of, kurtosis_adjusted, skewness_adjusted, variance
from sondeo.operators.quality import HIGH_MISSING_PCT

# Windows a task holds before it writes their counts and starts anew.
HELD_WINDOWS = 1 << 16

PROFILE = (
    "window_start timestamp_ntz, column string, n_rows bigint, missing bigint, constant boolean, mean double, std double, min double, "
    "max double, skewness double, kurtosis double"
)
ARRIVALS = "start bigint, rows bigint, last bigint"


def wall_micros(when: Column) -> Column:
    """Microseconds since 1970 of the wall clock, whatever the session's time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), when.cast("timestamp_ntz"))


def wall_clock(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def _measures(name: str, held: str, kind: T.DataType) -> Column:
    """The aggregates of column ``name``, held as ``held``; only numbers have moments. NaN is missing."""
    numeric = kind_of(kind) == "numeric"
    v = as_double(held) if numeric else F.col(held)
    v = F.when(~F.isnan(v), v) if numeric else v
    alike = v if numeric else F.when(v.isNotNull(), F.xxhash64(hashable(v, kind)))
    none = F.lit(None).cast("double")
    moments = {
        "mean": F.avg(v), "std": F.sqrt(variance(v)), "min": F.min(v), "max": F.max(v), "skewness": skewness_adjusted(v), "kurtosis": kurtosis_adjusted(v),
    } if numeric else dict.fromkeys(("mean", "std", "min", "max", "skewness", "kurtosis"), none)
    present = F.count(v)
    # a column without any value, or with one value and gaps, follows the batch rule: gaps count as a value
    constant = (present == 0) | (is_constant(alike) & (present == F.count(F.lit(1))))
    return F.struct(
        F.lit(name).alias("column"), F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - present).alias("missing"), constant.alias("constant"),
        *(m.alias(k) for k, m in moments.items()),
    )


def window_profile(df: DataFrame, when: Column, columns: Sequence[str], width: int, lateness: int) -> DataFrame:
    """One row per window of ``width`` seconds and column; rows without a time are in no window.

    On a stream, state is one row per open window: windows end with the watermark, ``lateness`` seconds behind the latest time seen. On a
    table there is no watermark and the same plan gives all windows.
    """
    held = {c: f"v{i}" for i, c in enumerate(columns)}
    rows = df.select(F.timestamp_micros(wall_micros(when)).alias("at"), *(col(c).alias(v) for c, v in held.items()))
    parts = F.array(*(_measures(c, v, df.schema[c].dataType) for c, v in held.items()))
    found = rows.withWatermark("at", f"{lateness} seconds").groupBy(F.window("at", f"{width} seconds").alias("span")).agg(parts.alias("parts"))
    return found.select(wall_clock(F.unix_micros("span.start")).alias("window_start"), F.inline("parts"))


def count_arrivals(df: DataFrame, when: Column, width: int) -> DataFrame:
    """(start, rows, last): partial counts of each task by window, and the latest time in it; NULL start for rows without a time."""
    step = width * 1_000_000
    schema = pa.schema([("start", pa.int64()), ("rows", pa.int64()), ("last", pa.int64())])

    def count(batches):
        held: dict[int, list[int]] = {}
        undated = 0

        def rows():
            starts = [*held, *([None] if undated else [])]
            return pa.RecordBatch.from_arrays([
                pa.array(starts, pa.int64()), pa.array([*(h[0] for h in held.values()), *([undated] if undated else [])], pa.int64()),
                pa.array([*(h[1] for h in held.values()), *([None] if undated else [])], pa.int64()),
            ], schema=schema)

        for batch in batches:
            micros = batch.column(0)
            undated += micros.null_count
            dated = micros.drop_null().to_numpy()
            starts, where, sizes = np.unique(dated // step * step, return_inverse=True, return_counts=True)
            last = np.full(len(starts), np.iinfo(np.int64).min)
            np.maximum.at(last, where, dated)
            for start, size, latest in zip(starts.tolist(), sizes.tolist(), last.tolist()):
                entry = held.setdefault(start, [0, latest])
                entry[0] += size
                entry[1] = max(entry[1], latest)
            if len(held) > HELD_WINDOWS:
                yield rows()
                held, undated = {}, 0
        if held or undated:
            yield rows()

    return df.select(wall_micros(when).alias("micros")).mapInArrow(count, ARRIVALS)


@dataclass
class WindowedProfile:
    """A windowed profile kept in ``folder``, which all executors share: closed windows, arrivals and both checkpoints.

    ``width`` and ``lateness`` are seconds. They, ``when`` and ``columns`` belong to the folder: other settings need another one.
    """

    folder: str
    when: str
    columns: list[str]
    width: int = 86_400
    lateness: int = 3_600

    def start(self, source: DataFrame, **trigger) -> list[StreamingQuery]:
        """Start both queries on a streaming frame; ``trigger`` as for ``DataStreamWriter.trigger``."""
        when = col(self.when)
        frames = {
            "windows": window_profile(source, when, self.columns, self.width, self.lateness),
            "arrivals": count_arrivals(source, when, self.width),
        }
        return [
            frame.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/{name}")
            .option("checkpointLocation", f"{self.folder}/checkpoint-{name}").trigger(**(trigger or {"availableNow": True})).start()
            for name, frame in frames.items()
        ]

    def advance(self, source: DataFrame) -> None:
        """Take in all that has come since the last call, then end; the error of a failed query is raised."""
        running = self.start(source, availableNow=True)
        try:
            for each in running:
                each.awaitTermination()
        finally:
            for each in running:
                each.stop()

    def profile(self, spark: SparkSession) -> DataFrame:
        """Closed windows: (window_start, column, n_rows, missing, missing_pct, high_missing, constant, moments of numbers)."""
        found = spark.read.schema(PROFILE).parquet(f"{self.folder}/windows")
        pct = F.col("missing") * 100.0 / F.col("n_rows")
        return found.select("window_start", "column", "n_rows", "missing", pct.alias("missing_pct"), (pct > HIGH_MISSING_PCT).alias("high_missing"), *found.columns[4:])

    def arrivals(self, spark: SparkSession) -> DataFrame:
        """(window_start, state, arrived, kept, late) of every window with an arrival.

        State is closed, open or undated (no time; NULL window). Open windows have no late rows; a window all of whose rows were late is closed with 0
        kept. Exact after ``advance``; while both queries run, one may be a batch ahead of the other.
        """
        met = spark.read.schema(ARRIVALS).parquet(f"{self.folder}/arrivals").groupBy("start").agg(F.sum("rows").alias("arrived"), F.max("last").alias("last"))
        latest = met.agg(F.max("last")).first()[0]
        # a watermark has milliseconds; without any time there is none
        mark = None if latest is None else latest // 1000 * 1000 - self.lateness * 1_000_000
        kept = spark.read.schema(PROFILE).parquet(f"{self.folder}/windows").where(F.col("column") == self.columns[0]).select("window_start", F.col("n_rows").alias("kept"))
        state = F.when(F.col("start").isNull(), "undated").when(F.col("start") + self.width * 1_000_000 <= F.lit(mark).cast("bigint"), "closed").otherwise("open")
        return met.select(wall_clock(F.col("start")).alias("window_start"), state.alias("state"), "arrived").join(kept, "window_start", "left").select(
            "window_start", "state", "arrived", F.when(F.col("state") == "closed", F.coalesce("kept", F.lit(0))).alias("kept"),
            F.when(F.col("state") == "closed", F.col("arrived") - F.coalesce("kept", F.lit(0))).otherwise(0).alias("late"),
        )

