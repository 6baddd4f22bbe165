"""Schema walks and column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType, T.CharType, T.VarcharType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Aggregate expressions per scan; wider tables take several scans so generated code stays compilable.
EXPRESSIONS_PER_SCAN = 100


def col(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, NUMERIC_TYPES):
        return "numeric"
    if isinstance(data_type, CATEGORICAL_TYPES):
        return "categorical"
    if isinstance(data_type, DATETIME_TYPES):
        return "datetime"
    return "unsupported"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGER_TYPES)


def as_double(name: str) -> Column:
    return col(name).cast("double")


@F.pandas_udf(T.StringType())
def two_decimals(v: pd.Series) -> pd.Series:
    """A double at two decimals by its exact value, as Python prints it; format_string rounds its shortest digits half up. Applied to result rows only."""
    return v.map("{:.2f}".format, na_action="ignore")


def as_text(df: DataFrame, name: str) -> Column:
    """One text form per distinct value; -0.0 and 0.0 are one value."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return (col(name) + F.lit(0.0)).cast("string")
    return col(name).cast("string")


def hashable(c: Column, kind: T.DataType) -> Column:
    """The value in a form that groups and hashes: a map, at any depth, as its sorted entries; a variant as text."""
    if not holds(kind, (T.MapType, T.VariantType)):
        return c
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(hashable(e["key"], kind.keyType).alias("key"), hashable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: hashable(e, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [hashable(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return F.to_json(c)


def holds(kind: T.DataType, wanted: tuple) -> bool:
    if isinstance(kind, wanted):
        return True
    if isinstance(kind, T.ArrayType):
        return holds(kind.elementType, wanted)
    if isinstance(kind, T.StructType):
        return any(holds(f.dataType, wanted) for f in kind.fields)
    return False


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def aggregate_rows(
    df: DataFrame, keys: Sequence, build: Callable[..., Sequence[Column]], per_key: int, group_by: Sequence[Column] = ()
) -> DataFrame:
    """One aggregate over ``df`` that returns a row per key.

    ``build(key)`` gives the aliased aggregates of one key. All keys share a scan (a few scans for very
    wide tables) and the single result row is turned into one row per key.
    """
    frames = []
    for part in chunks(list(keys), max(1, EXPRESSIONS_PER_SCAN // per_key)):
        rows = F.array(*[F.struct(*build(key)) for key in part]).alias("_rows")
        wide = df.groupBy(*group_by).agg(rows)
        names = [c for c in wide.columns if c != "_rows"]
        frames.append(wide.select(*[col(n) for n in names], F.inline("_rows")))
    return union_all(frames)


def unpivot(
    df: DataFrame, columns: dict[str, Column], keys: dict[str, Column] | None = None, name="column", value="value"
) -> DataFrame:
    """Long form: a row per input row and entry of ``columns`` (label -> expression of one common type)."""
    keys = keys or {}
    wide = df.select(
        *[expr.alias(f"__key_{k}") for k, expr in keys.items()], *[expr.alias(label) for label, expr in columns.items()]
    )
    long = wide.unpivot([F.col(f"__key_{k}") for k in keys], [col(label) for label in columns], name, value)
    return long.select(*[F.col(f"__key_{k}").alias(k) for k in keys], name, value)


def is_constant(c: Column) -> Column:
    """Aggregate: no two values differ. Merged partial moments leave a rounding residue, extremes do not."""
    return F.min(c) == F.max(c)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both sides are present; NULL where one side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return F.when(~is_constant(a) & ~is_constant(b), r)


def skewness_adjusted(c: Column) -> Column:
    """Bias-adjusted skewness (G1) from Spark's population skewness; NULL under three values, 0 without spread."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.when(is_constant(c), 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)))


def kurtosis_adjusted(c: Column) -> Column:
    """Bias-adjusted excess kurtosis (G2) from Spark's population excess kurtosis; NULL under four values, 0
    without spread."""
    n = F.count(c).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n >= 4, F.when(is_constant(c), 0.0).otherwise(adjusted))


def variance(c: Column) -> Column:
    """Sample variance, exactly 0 without spread; NULL under two values."""
    return F.when(F.count(c) >= 2, F.when(is_constant(c), 0.0).otherwise(F.var_samp(c)))
