"""Reading tables, normalising missing values, previews and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.columns import aggregate_rows, col
from sondeo.functions.dates import ZONED, in_utc

# The texts a CSV reader of the dataframe world takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalize(df: DataFrame, missing_tokens: Sequence[str] = ()) -> DataFrame:
    """NaN becomes NULL in float columns; the given texts become NULL in string columns."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        elif missing_tokens and isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*missing_tokens), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, missing_tokens=MISSING_TOKENS, multi_line: bool = False
) -> DataFrame:
    """CSV with a header row. Missing texts are removed before types are chosen, so one ``NA`` does not turn a
    numeric column into text. Pass ``schema`` to skip the scan that chooses the types; ``bad_values`` then counts the
    texts that do not fit it, which read as missing.

    ``multi_line`` reads line breaks inside quotes, at the price of one task for each file. Without it a record with
    the wrong number of fields, such as a part of a broken one, stops the job instead of being padded.
    """
    text = _csv_text(spark, path, missing_tokens, multi_line)
    if schema is None:
        schema = infer_types(text)
    return text.select(*[typed(col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def bad_values(
    spark: SparkSession, path: str, schema: T.StructType, missing_tokens=MISSING_TOKENS, multi_line: bool = False
) -> DataFrame:
    """(column, n): texts that are not missing and do not fit the type the schema gives them; only columns with any."""
    text = _csv_text(spark, path, missing_tokens, multi_line)

    def build(f):
        c = col(f.name)
        return [F.lit(f.name).alias("column"), F.count_if(c.isNotNull() & typed(c, f.dataType).isNull()).alias("n")]

    return aggregate_rows(text, list(schema.fields), build, 1).where("n > 0")


def _csv_text(spark: SparkSession, path: str, missing_tokens: Sequence[str], multi_line: bool) -> DataFrame:
    mode = "PERMISSIVE" if multi_line else "FAILFAST"
    return normalize(spark.read.csv(path, header=True, escape='"', multiLine=multi_line, mode=mode), missing_tokens)


def typed(text: Column, kind: T.DataType) -> Column:
    """A text as a value of a type, NULL if it does not fit. A time with a zone becomes its UTC clock."""
    if isinstance(kind, T.TimestampNTZType):
        return F.when(text.rlike(ZONED), in_utc(text.try_cast("timestamp"))).otherwise(text.try_cast(kind))
    return text.try_cast(kind)


def infer_types(text: DataFrame) -> T.StructType:
    """The narrowest of bigint, decimal(38), double, boolean, timestamp and string that every non-missing text fits.

    Whole numbers are never rounded: beyond 64 bits they are decimals, beyond 38 digits they stay text.
    """
    # Fixed patterns: the text forms of each type.
    whole = r"^\s*[+-]?\d+\s*$"
    forms = [
        (T.LongType(), lambda c: c.rlike(whole) & F.trim(c).try_cast("bigint").isNotNull()),
        (T.DecimalType(38, 0), lambda c: c.rlike(r"^\s*[+-]?\d{1,38}\s*$")),
        (T.StringType(), lambda c: c.rlike(whole)),
        (T.DoubleType(), lambda c: c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")),
        (T.BooleanType(), lambda c: c.rlike(r"^(True|False|TRUE|FALSE|true|false)$")),
        (T.TimestampNTZType(), lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$") | c.rlike(ZONED)),
    ]

    def build(name):
        fits = [F.coalesce(F.bool_and(form(col(name))), F.lit(False)) for _, form in forms]
        return [F.lit(name).alias("column"), F.array_position(F.array(*fits), True).cast("int").alias("form")]

    names = text.columns
    found = {r["column"]: r["form"] for r in aggregate_rows(text, names, build, len(forms)).collect()} if names else {}
    return T.StructType([T.StructField(c, forms[found[c] - 1][0] if found[c] else T.StringType()) for c in names])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize(spark.read.parquet(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return normalize(spark.read.orc(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return normalize(spark.read.json(path, schema=schema))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return normalize(spark.read.table(name))


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, for a look before the analysis."""
    return df.limit(rows)


def write_result(result: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result table to files. Some results have a row for each row of the data, so every task writes its own."""
    result.write.format(fmt).mode(mode).save(path)


def save_result_table(result: DataFrame, name: str, mode: str = "errorifexists") -> None:
    result.write.mode(mode).saveAsTable(name)
