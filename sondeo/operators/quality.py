"""Data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.columns import aggregate_rows, as_double, as_text, col, hashable, kind_of, unpivot
from sondeo.operators.profile import LONG_TEXT_BYTES, Profile, distinct_counts, kept_columns, missing_shares
from sondeo.plans.quantiles import group_sizes, quantiles
from sondeo.plans.scratch import stored

# Share of missing that flags a column, cardinality limits, fence width.
HIGH_MISSING_PCT = 40.0
CARDINALITY_SHARE, CARDINALITY_FLOOR = 0.05, 50
FENCE = 1.5
TOP_OUTLIERS = 5

# Rows at most this wide are grouped whole; wider rows are screened by a hash first.
NARROW_ROW_BYTES = 32
# A hash held by more than one in this many rows is counted where its rows stand.
HOT_ROWS = 4096


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and rows that repeat an earlier row (NULLs equal).

    Wide rows are first grouped by a 64-bit hash, which shuffles 8 bytes a row. Only rows whose hash repeats are
    then grouped by their full value, so hash collisions cannot count. Rows of hashes that hold more than one in ``HOT_ROWS`` rows, at most
    ``HOT_ROWS`` hashes, are counted in their own task before they move. Runs two jobs for wide tables.
    """
    df = df.select(*[hashable(col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    names = df.columns
    narrow = sum(8 if kind_of(df.schema[c].dataType) != "unsupported" else 64 for c in names) <= NARROW_ROW_BYTES
    fixed = not any(isinstance(df.schema[c].dataType, T.StringType) for c in names)
    whole = [col(c) for c in names]
    if narrow and fixed:
        groups = df.groupBy(*whole).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
        )
    hashed = df.select(F.xxhash64(*whole).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    suspects = stored(hashed.where(F.col("_n") > 1), "repeated")
    rows = df.count()
    is_hot = F.col("_n") > rows / HOT_ROWS
    rare = tagged = df.withColumn("_h", F.xxhash64(*whole))
    if any_hot := not suspects.where(is_hot).isEmpty():
        hot = F.broadcast(suspects.where(is_hot).select("_h"))
        rare = tagged.join(hot, "_h", "left_anti")
    # the optimizer broadcasts the other suspects when they are few and shuffles both sides otherwise
    repeated = rare.join(suspects.where(~is_hot).select("_h"), "_h", "left_semi")
    if any_hot:
        repeated = repeated.unionByName(tagged.join(hot, "_h", "left_semi"))
    groups = repeated.groupBy("_h", *whole).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.lit(rows).cast("long").alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def high_missing(df: DataFrame, limit: float = HIGH_MISSING_PCT) -> DataFrame:
    flagged = missing_shares(df).where(F.col("missing_pct") > limit)
    return flagged.orderBy(F.col("missing_pct").desc(), "ordinal").select("column", "missing_pct")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, NULL counting as a value. One pass, no distinct."""

    def build(key):
        i, name = key
        c = col(name)
        same = (F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c))
        return [F.lit(i).alias("ordinal"), F.lit(name).alias("column"), ((F.count(c) == 0) | same).alias("is_constant")]

    keys = [(i, f.name) for i, f in enumerate(df.schema.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return aggregate_rows(df, keys, build, 4).where("is_constant").orderBy("ordinal").select("column")


def high_cardinality(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """Categorical columns with more than max(50, 5 % of rows) distinct values."""
    names = list(columns) if columns is not None else kept_columns(df, "categorical", profile)
    per = distinct_counts(df, names)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(F.lit(float(CARDINALITY_FLOOR)), F.col("_rows") * CARDINALITY_SHARE)
    return per.crossJoin(F.broadcast(rows)).where(F.col("n_distinct") > limit).select("column", "n_distinct")


def quartile_fences(df: DataFrame, names: Sequence[str], exact: bool = True) -> dict[str, tuple[int, float, float]]:
    """Non-missing count and 1.5 IQR fences; columns under four values or with no spread are left out."""
    long = unpivot(df, {c: as_double(c) for c in names}).where(F.col("value").isNotNull())
    sizes = group_sizes(long, ["column"], "value").where(F.col("_n") >= 4)
    rows = {r["column"]: r["_n"] for r in sizes.collect()}  # one row per column
    if not rows:
        return {}
    fences = {}
    for r in quantiles(long.where(F.col("column").isin(*rows)), ["column"], "value", [0.25, 0.75], exact, sizes).collect():
        spread = r["q1"] - r["q0"]
        if spread != 0:
            fences[r["column"]] = (rows[r["column"]], r["q0"] - FENCE * spread, r["q1"] + FENCE * spread)
    return fences


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None, top: int | None = None, exact: bool = True
) -> DataFrame:
    """Columns with values outside the 1.5 IQR fences, most outliers first. Runs the quartile jobs at once.

    ``exact=False`` takes the quartiles from one scan of bounded summaries, within 1 / 10,000 of the rows in rank.
    """
    names = list(columns) if columns is not None else kept_columns(df, "numeric", profile)
    fences = quartile_fences(df, names, exact) if names else {}
    if not fences:
        return df.sparkSession.createDataFrame(
            [], "column string, n_outliers bigint, pct double, lower_bound double, upper_bound double"
        )

    def build(name):
        n, low, high = fences[name]
        c = as_double(name)
        outside = F.count_if((c < low) | (c > high))
        return [
            F.lit(names.index(name)).alias("ordinal"), F.lit(name).alias("column"), outside.alias("n_outliers"),
            (outside * 100.0 / n).alias("pct"), F.lit(low).alias("lower_bound"), F.lit(high).alias("upper_bound"),
        ]

    counts = aggregate_rows(df, [c for c in names if c in fences], build, 1)
    out = counts.where(F.col("n_outliers") > 0).orderBy(F.col("n_outliers").desc(), "ordinal")
    return (out.limit(top) if top else out).drop("ordinal")


def _cased_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, folded_key, value_key, folded, value, n): text values with their lower-cased form.

    Long texts are grouped by digests; the texts come along as plain values. Without a use for them they are not
    computed, so a count alone shuffles the keys only.
    """

    def short(text: Column) -> Column:
        return F.when(F.octet_length(text) > LONG_TEXT_BYTES, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)

    long = unpivot(df, {c: as_text(df, c) for c in names}).where(F.col("value").isNotNull())
    keyed = long.withColumns({"value_key": short(F.col("value")), "folded_key": short(F.lower("value"))})
    groups = keyed.groupBy("column", "folded_key", "value_key")
    return groups.agg(F.lower(F.min("value")).alias("folded"), F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))


def _text_columns(df: DataFrame, columns, profile) -> list[str]:
    names = list(columns) if columns is not None else kept_columns(df, "categorical", profile)
    return [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]


def case_inconsistency(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """Text columns with fewer distinct values after lower-casing."""
    names = _text_columns(df, columns, profile)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_values bigint, n_folded bigint")
    folded = _cased_values(df, names).groupBy("column", "folded_key").agg(F.count(F.lit(1)).alias("variants"))
    per = folded.groupBy("column").agg(F.sum("variants").alias("n_values"), F.count(F.lit(1)).alias("n_folded"))
    return per.where(F.col("n_values") > F.col("n_folded"))


def case_variants(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """The clashing spellings: (column, folded, value, n) for every lower-cased form with several spellings."""
    names = _text_columns(df, columns, profile)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, folded string, value string, n bigint")
    values = _cased_values(df, names)
    clashes = values.groupBy("column", "folded_key").agg(F.count(F.lit(1)).alias("variants")).where(F.col("variants") > 1)
    return values.join(clashes.select("column", "folded_key"), ["column", "folded_key"]).select("column", "folded", "value", "n")
