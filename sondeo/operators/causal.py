"""Reminders that correlation is not causation, and detection of treatment-like columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.columns import as_text, kind_of, unpivot
from sondeo.operators.eda import top_correlations
from sondeo.operators.profile import Profile, kept_columns

# Warning levels and the words a treatment column may hold.
STRONG, MODERATE = 0.70, 0.40
TREATMENT_WORDS = ("a", "b", "0", "1", "control", "treatment", "yes", "no", "true", "false")


def correlation_warnings(df: DataFrame, columns=None, profile: Profile | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Strong and moderate pairs among the top correlations."""
    top = pairs if pairs is not None else top_correlations(df, columns, profile)
    size = F.abs("r")
    level = F.when(size >= STRONG, "strong").when(size >= MODERATE, "moderate")
    return top.withColumn("level", level).where(F.col("level").isNotNull()).select("a", "b", "r", "level")


def binary_treatment(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """Columns with exactly two distinct values, both treatment words; the first in column order is marked.

    Every other value collapses into one "other" group before the shuffle, so the shuffle is a few hundred rows
    per column at most.
    """
    if columns is None:
        columns = kept_columns(df, "numeric", profile) + kept_columns(df, "categorical", profile)
    # a float prints as 0.0 or 1.0 and never matches a word
    names = [c for c in columns if not isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
             and kind_of(df.schema[c].dataType) in ("numeric", "categorical")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, is_first boolean")
    long = unpivot(df, {c: as_text(df, c) for c in names}).where(F.col("value").isNotNull())
    # no word is longer than nine letters, so longer texts need no lower-casing
    word = F.when((F.octet_length("value") <= 9) & F.lower("value").isin(*TREATMENT_WORDS), F.col("value"))
    values = long.select("column", word.alias("word")).groupBy("column", "word").agg(F.count(F.lit(1)).alias("n"))
    fits = values.groupBy("column").agg(F.count("word").alias("words"), F.count(F.lit(1)).alias("all"))
    hits = fits.where((F.col("words") == 2) & (F.col("all") == 2))
    order = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))
    first = hits.agg(F.min(order).alias("_first"))
    return hits.withColumn("_order", order).crossJoin(F.broadcast(first)).select(
        "column", (F.col("_order") == F.col("_first")).alias("is_first")
    )
