"""Column kinds, shape, missing values, date column, dataset type and identifier columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.columns import (
    DATETIME_TYPES, INTEGER_TYPES, aggregate_rows, as_text, col, columns_of_kind, is_integer, kind_of, unpivot,
)
from sondeo.functions.dates import ZONED, in_utc

# Date-like name fragments, the share of parsed rows that accepts a date column, the distinct
# share above which a column is an identifier, and the distinct dates up to which a table is cross-sectional.
DATE_WORDS = ("date", "time", "period", "year", "month", "week", "day", "timestamp")
DATE_SHARE = 0.70
IDENTIFIER_SHARE = 0.95
FEW_DATES = 5
TOP_MISSING = 5

# Fixed formats a text date column may have: (label, shape, pattern). The shape check keeps the parser away
# from texts it would reject, and an earlier format wins a tie.
ZONE = "zone"  # not a pattern: such texts are cast with their zone
DATE_FORMATS = (
    ("iso_date", r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ("iso_datetime", r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$", None),
    ("iso_month", r"^\d{4}-\d{2}$", "yyyy-MM"),
    ("slash_ymd", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("slash_mdy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("slash_dmy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("slash_mdy_time", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    ("slash_mdy_seconds", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    ("slash_mdy_half_day", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/yyyy h:mm a"),
    ("slash_mdy_half_day_seconds", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "M/d/yyyy h:mm:ss a"),
    ("iso_half_day", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2} [AP]M$", "yyyy-M-d h:mm a"),
    ("iso_zone", ZONED, ZONE),
    ("dash_dmy_time", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$", "d-M-yyyy H:mm"),
    ("dash_dmy", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    ("dot_dmy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("compact", r"^\d{8}$", "yyyyMMdd"),
    ("day_name_month", r"^\d{1,2}[ -][A-Z][a-z]{2}[ -]\d{4}$", "d[ ][-]MMM[ ][-]yyyy"),
    ("month_day_year", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    ("day_full_month_year", r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$", "d MMMM yyyy"),
    ("full_month_day_year", r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    ("full_month_year", r"^[A-Z][a-z]{2,8} \d{4}$", "MMMM yyyy"),
    ("month_year", r"^[A-Z][a-z]{2} \d{4}$", "MMM yyyy"),
)
# Every text of these formats has this shape and length; one cheap check stands for all of them at first.
DATE_SHAPE = r"^[0-9A-Z][0-9A-Za-z ,:./+-]*[0-9MZ]$"
SHORTEST_DATE, LONGEST_DATE = 7, 32
# Fixed formats an integer date column may have: (label, low, high).
INTEGER_DATES = (("yyyy", 1900, 2100), ("yyyymm", 190001, 210012), ("yyyymmdd", 19000101, 21001231))

# The distinct-count screen: a sketch of 2^16 registers and its relative standard error. Counts within six of
# these of a limit are taken exactly.
SCREEN_BITS, SCREEN_ERROR = 16, 0.0041
LONG_TEXT_BYTES = 64


@dataclass
class Profile:
    """What later operators need to know about a table; small values only."""

    columns: list[str]
    kinds: dict[str, str]
    rows: int = 0
    size_bytes: int = 0
    missing: dict[str, float] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    date_column: str | None = None
    date_format: str | None = None
    dataset_type: str = "cross_sectional"
    distinct: dict[str, int] = field(default_factory=dict)

    def when(self, df: DataFrame) -> Column:
        return date_value(df, self.date_column, self.date_format)

    @property
    def measures(self) -> list[str]:
        return [c for c in self.numeric if c != self.date_column]

    @property
    def ordered(self) -> bool:
        return self.date_column is not None and self.dataset_type in ("time_series", "panel")


def column_kinds(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, kind string")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))


# Bytes of one value of a fixed-width type.
TYPE_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def logical_bytes(df: DataFrame) -> Column:
    """Aggregate: fixed widths times rows plus the bytes of the texts."""
    fixed, texts = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            texts.append(F.coalesce(F.sum(F.octet_length(col(f.name)).cast("bigint")), F.lit(0)))
        elif kind_of(f.dataType) != "unsupported":
            fixed += TYPE_BYTES.get(f.dataType.simpleString(), 8)
    total = F.count(F.lit(1)) * F.lit(fixed)
    for t in texts:
        total = total + t
    return total


def size_estimate(df: DataFrame) -> DataFrame:
    return df.agg(logical_bytes(df).alias("bytes")).withColumn("megabytes", F.col("bytes") / (1024 * 1024))


def missing_profile(df: DataFrame, top: int | None = TOP_MISSING) -> DataFrame:
    """Columns with missing values and their percentage, worst first."""
    shares = missing_shares(df).where(F.col("missing_pct") > 0)
    ranked = shares.orderBy(F.col("missing_pct").desc(), "ordinal")
    return (ranked.limit(top) if top else ranked).select("column", "missing_pct")


def missing_shares(df: DataFrame) -> DataFrame:
    """(ordinal, column, missing_pct) for every column from one scan of the null masks."""

    def build(key):
        i, name = key
        return [
            F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
            F.coalesce(F.try_divide(F.count_if(col(name).isNull()) * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("missing_pct"),
        ]

    return aggregate_rows(df, list(enumerate(df.columns)), build, 1)


# --- date column -------------------------------------------------------------------------------------------


def date_value(df: DataFrame, name: str, label: str | None) -> Column:
    """The column as timestamp_ntz under one format; NULL where it does not parse."""
    data_type, c = df.schema[name].dataType, col(name)
    if kind_of(data_type) == "datetime":
        return c.cast("timestamp_ntz")
    if is_integer(df, name):
        low, high = next((lo, hi) for key, lo, hi in INTEGER_DATES if key == label)
        pattern = {"yyyy": "yyyy", "yyyymm": "yyyyMM", "yyyymmdd": "yyyyMMdd"}[label]
        return F.when(c.between(low, high), F.try_to_timestamp(c.cast("string"), F.lit(pattern)).cast("timestamp_ntz"))
    _, form, pattern = next(f for f in DATE_FORMATS if f[0] == label)
    text = F.when(_fits_length(c) & c.rlike(form), c)
    if pattern is None:
        return text.try_cast("timestamp_ntz")
    if pattern == ZONE:
        return in_utc(text.try_cast("timestamp"))
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def _fits_length(c: Column) -> Column:
    return F.octet_length(c).between(SHORTEST_DATE, LONGEST_DATE)


def date_columns(df: DataFrame) -> list[str]:
    """Columns that may hold dates, in order of preference: by name, then typed ones, then texts."""
    named = [c for c in df.columns if any(w in c.lower() for w in DATE_WORDS)]
    typed = [c for c in columns_of_kind(df, "datetime") if c not in named]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in named]
    usable = (*DATETIME_TYPES, *INTEGER_TYPES, T.StringType)
    return [c for c in named + typed + texts if isinstance(df.schema[c].dataType, usable)]


def date_like(df: DataFrame, name: str) -> Column:
    """Aggregate: an upper bound on the rows of the column that can parse under any format."""
    c = col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.count_if(_fits_length(c) & c.rlike(DATE_SHAPE))
    if is_integer(df, name):
        return F.count_if(F.greatest(*[c.between(low, high).cast("int") for _, low, high in INTEGER_DATES]) == 1)
    return F.count(c)


def formats_of(df: DataFrame, name: str) -> list[str]:
    data_type = df.schema[name].dataType
    if kind_of(data_type) == "datetime":
        return ["typed"]
    return [f[0] for f in (INTEGER_DATES if is_integer(df, name) else DATE_FORMATS)]


def date_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(preference, column, format, share): share of all rows that parse, one scan for all candidates."""
    names = date_columns(df) if columns is None else columns
    pairs = [(c, label) for c in names for label in formats_of(df, c)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "preference int, column string, format string, share double")

    def build(key):
        i, (name, label) = key
        share = F.try_divide(F.count(date_value(df, name, label)).cast("double"), F.count(F.lit(1)))
        return [
            F.lit(i).alias("preference"), F.lit(name).alias("column"), F.lit(label).alias("format"),
            F.coalesce(share, F.lit(0.0)).alias("share"),
        ]

    return aggregate_rows(df, list(enumerate(pairs)), build, 4)


def _likely(rows: int, counts: dict[str, int]) -> list[str]:
    """Columns that can still reach the accepted share; only these are parsed."""
    return [c for c, n in counts.items() if rows and n / rows >= DATE_SHARE]


def detect_date_column(df: DataFrame) -> DataFrame:
    """The accepted date column and its format; no row if no column parses well enough. Runs one screening job."""
    names = date_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[date_like(df, c).alias(f"t{i}") for i, c in enumerate(names)]).first()
    scores = date_scores(df, _likely(row["n"], {c: row[f"t{i}"] for i, c in enumerate(names)}))
    best = scores.where(F.col("share") > 0).orderBy(F.col("share").desc(), "preference").limit(1)
    return best.where(F.col("share") >= DATE_SHARE).select("column", "format", "share")


# --- dataset type ------------------------------------------------------------------------------------------


def classify_dataset(df: DataFrame, when: Column | None) -> DataFrame:
    """One row: distinct dates, dated rows and the dataset type they imply."""
    if when is None:
        return df.sparkSession.createDataFrame(
            [(0, 0, "cross_sectional")], "distinct_dates bigint, dated_rows bigint, dataset_type string"
        )
    per_date = df.select(when.alias("d")).where(F.col("d").isNotNull()).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    counts = per_date.agg(
        F.count(F.lit(1)).alias("distinct_dates"), F.coalesce(F.sum("n"), F.lit(0)).alias("dated_rows")
    )
    kind = (
        F.when(F.col("distinct_dates") <= FEW_DATES, "cross_sectional")
        .when(F.col("distinct_dates") == F.col("dated_rows"), "time_series")
        .otherwise("panel")
    )
    return counts.withColumn("dataset_type", kind)


# --- distinct values ---------------------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over the non-missing values of all columns in one shuffle.

    Long texts are grouped by a SHA-256 digest, and the text itself comes along as one plain value for each group. They
    are counted apart, so that short values keep the faster aggregation by hash.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    n = F.count(F.lit(1)).alias("n")
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    long = unpivot(df, {c: as_text(df, c) for c in columns}).where(F.octet_length("value") <= LONG_TEXT_BYTES)
    counts = long.groupBy("column", "value").agg(n)
    if not texts:
        return counts
    groups = value_groups(df, texts, F.octet_length("value") > LONG_TEXT_BYTES).agg(F.min("value").alias("value"), n)
    return counts.unionByName(groups.select("column", "value", "n"))


def value_groups(df: DataFrame, columns: list[str], keep: Column | None = None):
    """The non-missing values of all columns, grouped by column and ``key``: the text, or its digest if it is long."""
    long = unpivot(df, {c: as_text(df, c) for c in columns}).where(F.col("value").isNotNull() if keep is None else keep)
    digest = F.concat(F.lit("sha256:"), F.sha2("value", 256))
    key = F.when(F.octet_length("value") > LONG_TEXT_BYTES, digest).otherwise(F.col("value"))
    return long.withColumn("key", key).groupBy("column", "key")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct) of non-missing values, exact; 0 for a column without values."""
    found = _distinct(df, columns)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(found), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n_distinct"))


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): counting needs the keys only, so no long text is shuffled."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint")
    return value_groups(df, columns).agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def identifier_candidates(df: DataFrame, date_column: str | None = None) -> list[str]:
    texts = columns_of_kind(df, "categorical")
    whole = [c for c in columns_of_kind(df, "numeric") if is_integer(df, c)]
    return [c for c in texts + whole if c != date_column]


def estimated_distinct(df: DataFrame, name: str) -> Column:
    """Aggregate: a fixed-size sketch of the distinct values of an integer, boolean or text column."""
    c = col(name) if isinstance(df.schema[name].dataType, T.StringType) else col(name).cast("bigint")
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, SCREEN_BITS)), F.lit(0))


def screen_distinct(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, float]]:
    """Row count and estimated distinct values from one scan whose state is a fixed-size sketch per column."""
    estimates = [estimated_distinct(df, c).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *estimates).first()
    return row["n"], {c: row[f"d{i}"] for i, c in enumerate(columns)}


def exact_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    return {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns).collect()}


def find_identifiers(df: DataFrame, rows: int, estimates: dict[str, float]) -> tuple[list[str], dict[str, int]]:
    """Columns whose distinct share of all rows exceeds the limit, and the exact counts taken on the way.

    Only columns whose estimate is too close to the limit to decide are counted exactly.
    """
    limit, slack = IDENTIFIER_SHARE * max(rows, 1), 6 * SCREEN_ERROR
    close = [c for c, d in estimates.items() if limit * (1 - slack) <= d <= limit * (1 + slack)]
    exact = exact_counts(df, close)
    return [c for c, d in estimates.items() if exact.get(c, d) > limit], exact


def identifier_columns(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """(ordinal, column, is_identifier) for every column the rule applies to. Runs up to two jobs."""
    names = identifier_candidates(df, date_column)
    rows, estimates = screen_distinct(df, names)
    found, _ = find_identifiers(df, rows, estimates)
    out = [(i, c, c in found) for i, c in enumerate(df.columns) if c in names]
    return df.sparkSession.createDataFrame(out, "ordinal int, column string, is_identifier boolean")


# --- bundle ------------------------------------------------------------------------------------------------


def build_profile(df: DataFrame) -> Profile:
    """Profile a table: one scan for counts, sketches, sizes and date-like shapes; parsing and exact counting only
    for the columns that these leave open."""
    p = Profile(columns=df.columns, kinds={f.name: kind_of(f.dataType) for f in df.schema.fields})
    names = identifier_candidates(df)
    dates = date_columns(df)
    aggs = [F.count(F.lit(1)).alias("n"), logical_bytes(df).alias("bytes")]
    aggs += [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    aggs += [estimated_distinct(df, c).alias(f"d{i}") for i, c in enumerate(names)]
    aggs += [date_like(df, c).alias(f"t{i}") for i, c in enumerate(dates)]
    row = df.agg(*aggs).first()
    p.rows, p.size_bytes = row["n"], row["bytes"]
    if p.rows:
        p.missing = {c: 100.0 * (p.rows - row[f"c{i}"]) / p.rows for i, c in enumerate(df.columns)}
    likely = _likely(p.rows, {c: row[f"t{i}"] for i, c in enumerate(dates)})
    if likely and kind_of(df.schema[likely[0]].dataType) == "datetime" and p.missing[likely[0]] == 0:
        p.date_column, p.date_format = likely[0], "typed"  # nothing can beat the first column with every row dated
    elif likely:
        best = date_scores(df, likely).orderBy(F.col("share").desc(), "preference").first()
        if best["share"] >= DATE_SHARE:
            p.date_column, p.date_format = best["column"], best["format"]
    estimates = {c: row[f"d{i}"] for i, c in enumerate(names) if c != p.date_column}
    if p.date_column is not None:
        p.dataset_type = classify_dataset(df, p.when(df)).first()["dataset_type"]
    p.identifiers, p.distinct = find_identifiers(df, p.rows, estimates)
    kept = [c for c in df.columns if c not in p.identifiers]
    p.numeric = [c for c in kept if p.kinds[c] == "numeric"]
    p.categorical = [c for c in kept if p.kinds[c] == "categorical"]
    p.datetime = [c for c in kept if p.kinds[c] == "datetime"]
    return p


def profile_table(df: DataFrame, p: Profile | None = None) -> DataFrame:
    """One row per column: kind, missing share, identifier and date flags."""
    p = p or build_profile(df)
    rows = [
        (i, c, p.kinds[c], p.missing.get(c, 0.0), c in p.identifiers, c == p.date_column)
        for i, c in enumerate(p.columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, kind string, missing_pct double, is_identifier boolean, is_date boolean"
    )


def profile_summary(df: DataFrame, p: Profile | None = None) -> DataFrame:
    """One row for the table."""
    p = p or build_profile(df)
    row = (p.rows, len(p.columns), len(p.numeric), len(p.categorical), len(p.datetime), p.size_bytes,
           p.date_column, p.dataset_type, ", ".join(p.identifiers))
    return df.sparkSession.createDataFrame(
        [row],
        "rows bigint, columns bigint, numeric bigint, categorical bigint, datetime bigint, bytes bigint,"
        " date_column string, dataset_type string, identifiers string",
    )


def kept_columns(df: DataFrame, kind: str, profile: Profile | None) -> list[str]:
    """Columns of a kind: the profile's choice, or by schema alone when no profile is given."""
    if profile is None:
        return columns_of_kind(df, kind)
    return {"numeric": profile.measures, "categorical": profile.categorical}[kind]
