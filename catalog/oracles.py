"""The SQL that must return the same rows as each query, written independently of the operators."""

from __future__ import annotations

from itertools import combinations

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SERIES = ["user_id", "value", "cycle", "stepped"]

ORACLES: dict[str, str] = {}


def rnd(expr: str, decimals: int = 6) -> str:
    # adding zero turns a rounded -0.0 into 0.0
    return f"round({expr}, {decimals}) + 0.0"


def finite(expr: str) -> str:
    return f"CASE WHEN isfinite({expr}) THEN {expr} END"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


FLAWED = """flawed AS (
  SELECT event_id, ts, user_id,
    CASE WHEN event_id % 7 = 0 THEN upper(event_type) ELSE event_type END AS event_type,
    CASE WHEN event_id % 10 <> 0 THEN value END AS value, props, 1 AS fixed, CAST(NULL AS DOUBLE) AS empty,
    CASE WHEN event_id % 5 < 2 THEN value END AS sparse FROM events),
dirty AS (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE event_id % 50 = 0)"""
DIRTY_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props", "fixed", "empty", "sparse"]

GAPPY = """gappy AS (
  SELECT event_id, ts, CAST(user_id AS DOUBLE) AS user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
    CAST(event_id % 7 AS DOUBLE) AS cycle,
    value + CASE WHEN ts >= TIMESTAMP '2024-01-11' THEN 40 ELSE 0 END AS stepped FROM events),
placed AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM gappy)"""

FILLED = GAPPY + """,
near AS (
  SELECT *,
    last_value(value IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp,
    first_value(value IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp
  FROM placed),
filled AS (
  SELECT pos, ts, user_id, cycle, stepped,
    CASE WHEN value IS NOT NULL THEN value WHEN lp IS NULL THEN rv WHEN rp IS NULL THEN lv
         ELSE lv + (rv - lv) / (rp - lp) * (pos - lp) END AS value FROM near),
series AS (
""" + union([f"SELECT '{c}' AS series, pos, ts, {c} AS y FROM filled" for c in SERIES]) + """),
sized AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM series)"""

# two-sided t and upper F tails by Simpson's rule on the densities
def t_tail(t: str, v: str) -> str:
    return f"""CASE WHEN abs({t}) > 60 THEN 0.0 ELSE greatest(0.0, 1 - 2 * list_sum(list_transform(range(0, 4001), lambda i:
  (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0) - (({v}) + 1) / 2.0 * ln(1 + (abs({t}) * i / 4000.0) ** 2 / ({v})))
  / sqrt(({v}) * pi()))) * abs({t}) / 4000.0 / 3) END"""


def f_tail(f: str, a: str, b: str) -> str:
    return f"""greatest(0.0, 1 - list_sum(list_transform(range(0, 4001), lambda i:
  (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * CASE WHEN i = 0 THEN CASE WHEN {a} = 2 THEN 1.0 ELSE 0.0 END ELSE exp(
      lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0) + {a} / 2.0 * ln({a} / CAST({b} AS DOUBLE))
      + ({a} / 2.0 - 1) * ln({f} * i / 4000.0) - ({a} + {b}) / 2.0 * ln(1 + {a} / CAST({b} AS DOUBLE) * {f} * i / 4000.0)) END
  )) * {f} / 4000.0 / 3)"""


# --- sources and profile -----------------------------------------------------------------------------------

ORACLES["csv_scan"] = """SELECT count(*) AS n, count(CASE WHEN event_id % 10 <> 0 THEN value END) AS n_values,
  round(sum(CASE WHEN event_id % 10 <> 0 THEN value END), 2) AS total, 'bigint' AS id_type, 'double' AS value_type,
  count(DISTINCT event_id) AS long_ids, CAST(9000000000000000000 + max(event_id) AS VARCHAR) AS last_long_id,
  CAST(CAST(100000000000000000000 AS HUGEINT) + max(event_id) AS VARCHAR) AS last_wide_id, count(*) AS broken_lines,
  strftime(date_trunc('second', min(ts)) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS first_at FROM events"""
KINDS = """CASE WHEN column_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'categorical'
  WHEN column_type IN ('DATE', 'TIMESTAMP') THEN 'datetime' ELSE 'unsupported' END"""
_KIND_COLUMNS = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "events": "event_id ts user_id event_type value props",
    "embeddings": "vec_id embedding label",
}
ORACLES["column_kinds"] = "SELECT \"table\", \"column\", " + KINDS + " AS kind, n FROM (" + union([
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", any_value(typeof({c})) AS column_type, count({c}) AS n FROM {t}" for t, cs in _KIND_COLUMNS.items() for c in cs.split()
]) + ")"
ORACLES["shape"] = "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem"
ORACLES["size_estimate"] = """SELECT bytes, round(bytes / 1048576.0, 6) AS megabytes FROM (
  SELECT CAST(count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) AS BIGINT) AS bytes FROM documents)"""
ORACLES["detect_date_column"] = """SELECT 'order_day' AS "column", 'iso_date' AS format,
  round(count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS share FROM orders"""
ORACLES["missing_profile"] = f"WITH {FLAWED} SELECT * FROM (" + union(
    [f"SELECT '{c}' AS \"column\", round(100.0 * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 6) AS missing_pct FROM dirty"
     for c in DIRTY_COLUMNS]
) + ") WHERE missing_pct > 0"
ORACLES["classify_dataset"] = "SELECT distinct_dates, dated_rows, CASE WHEN distinct_dates <= 5 THEN 'cross_sectional' WHEN distinct_dates = dated_rows THEN 'time_series' ELSE 'panel' END AS dataset_type, \"table\" FROM (" + union(
    [f"SELECT '{t}' AS \"table\", count(DISTINCT {c}) AS distinct_dates, count({c}) AS dated_rows FROM {t}"
     for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
) + ")"
ORACLES["identifier_columns"] = union(
    [f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", count(DISTINCT {c}) > 0.95 * count(*) AS is_identifier FROM customer"
     for i, c in ((0, "c_custkey"), (1, "c_name"), (2, "c_nationkey"), (4, "c_mktsegment"))]
)
ORACLES["value_counts"] = union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY {c}"
     for c in ("o_orderstatus", "o_orderpriority", "o_custkey")]
)
_ORDER_KINDS = (
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
    ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"),
)
ORACLES["profile_table"] = union(
    [f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", '{k}' AS kind, "
     f"round(100.0 * count(CASE WHEN {c} IS NULL THEN 1 END) / count(*), 6) AS missing_pct, "
     + (f"count(DISTINCT {c}) > 0.95 * count(*)" if c != "o_totalprice" and k != "datetime" else "false")
     + f" AS is_identifier, {'true' if k == 'datetime' else 'false'} AS is_date FROM orders"
     for i, (c, k) in enumerate(_ORDER_KINDS)]
)
ORACLES["profile_summary"] = """SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS numeric, CAST(2 AS BIGINT) AS categorical,
  CAST(1 AS BIGINT) AS datetime, CAST(count(*) * 32 + sum(strlen(event_type)) + sum(strlen(props)) AS BIGINT) AS bytes, 'ts' AS date_column,
  CASE WHEN count(DISTINCT ts) = count(*) THEN 'time_series' ELSE 'panel' END AS dataset_type,
  CASE WHEN count(DISTINCT event_id) > 0.95 * count(*) THEN 'event_id' ELSE '' END AS identifiers FROM events"""

# --- quality -----------------------------------------------------------------------------------------------

ORACLES["duplicate_rows"] = f"""WITH {FLAWED} SELECT (SELECT count(*) FROM dirty) AS rows,
  (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows"""
ORACLES["high_missing"] = ORACLES["missing_profile"].replace("missing_pct > 0", "missing_pct > 40")
ORACLES["constant_columns"] = f"WITH {FLAWED} SELECT \"column\" FROM (" + union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS k FROM dirty" for c in DIRTY_COLUMNS]
) + ") WHERE k <= 1"
ORACLES["high_cardinality"] = "SELECT \"column\", n_distinct FROM (" + union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n FROM documents" for c in ("text", "lang", "source")]
) + ") WHERE n_distinct > greatest(50, 0.05 * n)"
ORACLES["iqr_outliers"] = f"WITH {FLAWED}, long AS (" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM dirty WHERE {c} IS NOT NULL" for c in ("user_id", "value", "sparse", "fixed")]
) + """), q AS (SELECT "column", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1),
b AS (SELECT "column", n, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE n >= 4 AND q3 <> q1)
SELECT "column", n_outliers, round(100.0 * n_outliers / n, 4) AS pct, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound FROM (
  SELECT "column", n, lo, hi, count(CASE WHEN v < lo OR v > hi THEN 1 END) AS n_outliers FROM long JOIN b USING ("column") GROUP BY 1, 2, 3, 4)
WHERE n_outliers > 0"""
ORACLES["case_inconsistency"] = f"WITH {FLAWED} SELECT * FROM (" + union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_values, count(DISTINCT lower({c})) AS n_folded FROM dirty" for c in ("event_type", "props")]
) + ") WHERE n_values > n_folded"
ORACLES["case_variants"] = f"WITH {FLAWED}, long AS (" + union(
    [f"SELECT '{c}' AS \"column\", lower({c}) AS folded, {c} AS value, count(*) AS n FROM dirty GROUP BY 1, 2, 3" for c in ("event_type", "props")]
) + """) SELECT * FROM long WHERE ("column", folded) IN (SELECT ("column", folded) FROM long GROUP BY "column", folded HAVING count(*) > 1)"""

ORACLES["case_variants_long"] = """WITH long AS (SELECT 'text' AS "column", lower(text) AS folded, text AS value, count(*) AS n FROM (
  SELECT text FROM documents UNION ALL SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM documents WHERE doc_id % 7 = 0) GROUP BY 2, 3)
SELECT "column", sha256(folded) AS folded, sha256(value) AS value, n FROM long WHERE folded IN (SELECT folded FROM long GROUP BY folded HAVING count(*) > 1)"""

# --- exploration -------------------------------------------------------------------------------------------

ORACLES["univariate"] = union(
    [f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS ordinal, count({c}) AS n, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS std, "
     f"{rnd(f'CAST(min({c}) AS DOUBLE)', 4)} AS min, {rnd(f'CAST(max({c}) AS DOUBLE)', 4)} AS max, {rnd(f'skewness({c})', 4)} AS skewness, "
     f"{rnd(f'kurtosis({c})', 4)} AS kurtosis FROM lineitem" for i, c in enumerate(LINEITEM)]
)
ORACLES["describe"] = union(
    [f"SELECT '{c}' AS \"column\", count({c}) AS n, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS std, "
     f"{rnd(f'CAST(min({c}) AS DOUBLE)', 4)} AS min, {rnd(f'CAST(max({c}) AS DOUBLE)', 4)} AS max, "
     + ", ".join(f"{rnd(f'quantile_cont(CAST({c} AS DOUBLE), {q})', 4)} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
     + " FROM lineitem" for c in LINEITEM]
)
_MOMENT_COLUMNS = ["user_id", "value", "sparse", "fixed", "empty"]
for _name in ("skewness", "kurtosis"):
    ORACLES[_name] = f"WITH {FLAWED} " + union(
        [f"SELECT '{c}' AS \"column\", CASE WHEN count({c}) > 3 AND min({c}) = max({c}) THEN 0.0 ELSE "
         f"{rnd(finite(f'{_name}(CAST({c} AS DOUBLE))'))} END AS {_name} FROM dirty" for c in _MOMENT_COLUMNS]
    )
ORACLES["most_skewed"] = "SELECT \"column\", " + rnd("s", 5) + " AS skewness, " + rnd("k", 5) + " AS kurtosis FROM (" + union(
    [f"SELECT '{c}' AS \"column\", {i} AS o, skewness({c}) AS s, kurtosis({c}) AS k FROM lineitem" for i, c in enumerate(LINEITEM)]
) + ") ORDER BY abs(s) DESC, o LIMIT 5"
ORACLES["pearson_matrix"] = union(
    [f"SELECT '{a}' AS a, '{b}' AS b, {rnd(finite(f'corr({a}, {b})'))} AS r FROM lineitem" for a in LINEITEM for b in LINEITEM]
)
ORACLES["pearson_pairs"] = f"WITH {FLAWED} " + union(
    [f"SELECT '{a}' AS a, '{b}' AS b, {rnd(finite(f'corr({a}, {b})'))} AS r FROM dirty"
     for a, b in combinations(["event_id", "user_id", "value", "sparse", "fixed", "empty"], 2)]
)


def ranked_corr(source: str, a: str, b: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return (f"SELECT '{a}' AS a, '{b}' AS b, {rnd(finite('corr(x, y)'))} AS r FROM (SELECT {rank(a)} AS x, {rank(b)} AS y "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


ORACLES["spearman_matrix"] = union([ranked_corr("lineitem", a, b) for a in LINEITEM for b in LINEITEM])
ORACLES["spearman_pairs"] = f"WITH {FLAWED} " + union(
    [ranked_corr("dirty", a, b) for a, b in combinations(["user_id", "value", "sparse"], 2)]
)
ORACLES["average_rank"] = union(
    [f"SELECT '{c}' AS \"column\", CAST(v AS DOUBLE) AS value, n, CAST(sum(n) OVER (ORDER BY v) - n + (n + 1) / 2.0 AS DOUBLE) AS rank "
     f"FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY {c})" for c in ("o_custkey", "o_totalprice")]
)
ORACLES["top_correlations"] = "WITH wide AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) SELECT a, b, round(round(r, 3), 6) + 0.0 AS r FROM (" + union(
    [f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, {finite(f'corr({a}, {b})')} AS r FROM wide"
     for (i, a), (j, b) in combinations(enumerate([*LINEITEM, "net"]), 2)]
) + ") ORDER BY abs(r) DESC NULLS LAST, i, j LIMIT 10"
ORACLES["mutual_information"] = "WITH binned AS (SELECT " + ", ".join(
    f"CAST(floor(16.0 * (rank() OVER (ORDER BY {c}) - 1) / count(*) OVER ()) AS INT) AS {c}" for c in LINEITEM
) + " FROM lineitem) SELECT a, b, " + rnd("mi") + " AS mi FROM (" + union(
    [f"""SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, greatest(sum(p * ln(p / (px * py))), 0) AS mi FROM (
      SELECT p, sum(p) OVER (PARTITION BY x) AS px, sum(p) OVER (PARTITION BY y) AS py FROM (
        SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM binned) AS p FROM binned GROUP BY 1, 2))"""
     for (i, a), (j, b) in combinations(enumerate(LINEITEM), 2)]
) + ") ORDER BY mi DESC, i, j LIMIT 10"
ORACLES["mutual_information"] = ORACLES["mutual_information"].replace("ORDER BY mi DESC, i, j", "ORDER BY round(mi, 12) DESC, i, j")
ORACLES["categorical_cardinality"] = union(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_returnflag", "l_linestatus")]
)
ORACLES["histogram"] = "WITH long AS (" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in ("l_partkey", "l_quantity", "l_extendedprice", "l_orderkey", "l_suppkey", "l_tax")]
) + """), edge AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM long GROUP BY 1),
held AS (SELECT "column", least(30, CAST(floor(30 * (v - lo) / (hi - lo)) AS BIGINT) + 1) AS bin, count(*) AS n FROM long JOIN edge USING ("column") GROUP BY 1, 2)
SELECT e."column", g.bin, round(lo + (hi - lo) / 30 * (g.bin - 1), 4) AS low, round(lo + (hi - lo) / 30 * g.bin, 4) AS high, coalesce(h.n, 0) AS n
FROM edge e CROSS JOIN (SELECT unnest(range(1, 31)) AS bin) g LEFT JOIN held h ON h."column" = e."column" AND h.bin = g.bin"""

_WIDE = """wide AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
  l_quantity * 2000 {sign} l_extendedprice * (1 - l_discount) AS blend FROM lineitem)"""
_WIDE_NAMES = ["l_quantity", "l_extendedprice", "net", "blend"]
_WIDE_PAIRS = union(
    [f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, round(corr({a}, {b}), 3) AS r FROM wide" for (i, a), (j, b) in combinations(enumerate(_WIDE_NAMES), 2)]
)
ORACLES["correlation_warnings"] = f"WITH {_WIDE.format(sign='+')} SELECT a, b, r + 0.0 AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS level FROM ({_WIDE_PAIRS}) WHERE abs(r) >= 0.4"
ORACLES["relationship_statements"] = f"""WITH {_WIDE.format(sign='-')} SELECT a, b,
  printf('%s ~ %s: %s %s, r %.2f', a, b, CASE WHEN abs(r) >= 0.7 THEN 'strongly' WHEN abs(r) >= 0.4 THEN 'moderately' ELSE 'weakly' END,
    CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, r) AS statement FROM ({_WIDE_PAIRS}) ORDER BY abs(r) DESC, i, j LIMIT 5"""
ORACLES["binary_treatment"] = "SELECT \"column\", o = min(o) OVER () AS is_first FROM (" + union(
    [f"SELECT '{c}' AS \"column\", {i} AS o, count(DISTINCT {c}) AS k, bool_and(lower(CAST({c} AS VARCHAR)) IN "
     f"('a', 'b', '0', '1', 'control', 'treatment', 'yes', 'no', 'true', 'false')) AS fits FROM labels" for i, c in enumerate(("doc_id", "quality", "toxic"))]
) + ") WHERE k = 2 AND fits"

# --- ordered sequences -------------------------------------------------------------------------------------

ORACLES["with_position"] = """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(o_orderkey AS DOUBLE) AS o_orderkey,
  round(o_totalprice, 6) AS o_totalprice FROM orders"""
ORACLES["interpolate_linear"] = f"WITH {FILLED} SELECT series, pos, {rnd('y')} AS y FROM series WHERE series = 'value'"
ORACLES["lag_within_series"] = f"WITH {GAPPY} " + union(
    [f"SELECT '{c}' AS series, pos, {rnd(c)} AS y, {rnd(f'lag({c}, 1) OVER (ORDER BY pos)')} AS lag_1, {rnd(f'lag({c}, 7) OVER (ORDER BY pos)')} AS lag_7 FROM placed"
     for c in ("value", "stepped")]
)
ORACLES["infer_rolling_window"] = "WITH gaps AS (" + union(
    [f"SELECT '{t}' AS source, CAST(epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS DOUBLE) AS g FROM {t}" for t, c in (("events", "ts"), ("orders", "o_orderdate"))]
) + """), mid AS (SELECT source, quantile_cont(g, 0.5) AS m FROM gaps WHERE g IS NOT NULL GROUP BY 1)
SELECT source, round(m, 1) AS median_micros, CAST(CASE WHEN floor(m / 86400000000) <= 1 THEN 7 WHEN floor(m / 86400000000) <= 7 THEN 4 ELSE 3 END AS BIGINT) AS rolling_window FROM mid"""
ORACLES["rank_by_variance"] = "SELECT \"column\", round(v, 4) AS variance FROM (" + union(
    [f"SELECT '{c}' AS \"column\", {i} AS o, var_samp({c}) AS v FROM lineitem" for i, c in enumerate(LINEITEM)]
) + ") ORDER BY v DESC, o LIMIT 5"

STATS = FILLED + f""",
stats AS (SELECT series, any_value(n) AS n, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept, regr_r2(y, pos) AS r2,
    CASE WHEN arg_min(y, pos) = 0 THEN 1e-9 ELSE arg_min(y, pos) END AS "start", arg_max(y, pos) AS "end", var_samp(y) AS spread,
    avg(y) FILTER (pos < n // 2) AS m1, var_samp(y) FILTER (pos < n // 2) AS v1, count(*) FILTER (pos < n // 2) AS n1,
    avg(y) FILTER (pos >= n // 2) AS m2, var_samp(y) FILTER (pos >= n // 2) AS v2, count(*) FILTER (pos >= n // 2) AS n2
  FROM sized GROUP BY series),
tested AS (SELECT *, sign(slope) * sqrt(r2) * sqrt((n - 2) / (1 - r2)) AS t, ("end" - "start") / abs("start") * 100 AS pct_change,
    (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS break_t,
    (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS break_df FROM stats),
judged AS (SELECT *, {t_tail('t', 'n - 2')} AS p_value, {t_tail('break_t', 'break_df')} AS break_p FROM tested),
-- the ranking uses the raw values, so the gappy column keeps its own variance
spreads AS ({union([f"SELECT '{c}' AS series, {i} AS o, var_samp({c}) AS raw FROM gappy" for i, c in enumerate(SERIES)])}),
ordered AS (SELECT series, row_number() OVER (ORDER BY raw DESC, o) AS ordinal FROM spreads),
trends AS (SELECT *, CASE WHEN abs(pct_change) > 10 AND p_value < 0.05 AND pct_change > 0 THEN 'upward'
    WHEN abs(pct_change) > 10 AND p_value < 0.05 THEN 'downward' ELSE 'stable' END AS direction, break_p < 0.05 AS structural_break
  FROM judged JOIN ordered USING (series))"""
ORACLES["ols_trend"] = f"WITH {STATS} SELECT series, {rnd('slope')} AS slope, {rnd('intercept')} AS intercept, {rnd('r2')} AS r2, {rnd('t')} AS t, {rnd('p_value')} AS p_value FROM trends"
ORACLES["pct_change"] = f"WITH {STATS} SELECT series, {rnd(chr(34) + 'start' + chr(34), 4)} AS \"start\", {rnd(chr(34) + 'end' + chr(34), 4)} AS \"end\", {rnd('pct_change', 2)} AS pct_change FROM trends"
ORACLES["trend_direction"] = f"WITH {STATS} SELECT series AS \"column\", {rnd('pct_change', 2)} AS pct_change, {rnd('p_value', 4)} AS p_value, direction FROM trends"
ORACLES["trend_table"] = f"""WITH {STATS} SELECT series AS "column", {rnd('slope', 4)} AS slope, {rnd('r2', 4)} AS r2, {rnd('p_value', 4)} AS p_value,
  {rnd('"start"', 4)} AS "start", {rnd('"end"', 4)} AS "end", {rnd('pct_change', 2)} AS pct_change, direction, structural_break, ordinal FROM trends"""
ORACLES["structural_break"] = f"WITH {STATS} SELECT series, {rnd('break_t', 5)} AS break_t, {rnd('break_df', 5)} AS break_df, {rnd('break_p', 5)} AS break_p, structural_break FROM trends"
ORACLES["rolling_mean"] = f"""WITH {FILLED} SELECT series, pos, {rnd('y')} AS y,
  {rnd('avg(y) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS rolling_mean FROM series WHERE series IN ('value', 'stepped')"""
ORACLES["ols_fitted_line"] = f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS y FROM orders),
fit AS (SELECT regr_slope(y, pos) AS s, regr_intercept(y, pos) AS i FROM o)
SELECT 'o_totalprice' AS series, pos, {rnd('y', 3)} AS y, {rnd('i + s * pos', 3)} AS fitted FROM o, fit"""
ORACLES["break_marker"] = f"""WITH {STATS} SELECT t.series, f.pos, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS "at"
  FROM trends t JOIN filled f ON f.pos = t.n // 2 WHERE t.structural_break"""
ORACLES["trend_statements"] = f"""WITH {STATS} SELECT series AS "column", CASE
  WHEN p_value >= 0.05 THEN printf('%s: %+.1f%%, within chance', series, pct_change)
  WHEN direction = 'upward' THEN printf('%s: up %.1f%%', series, pct_change)
  WHEN direction = 'downward' THEN printf('%s: down %.1f%%', series, abs(pct_change))
  ELSE printf('%s: stable, %+.1f%%', series, pct_change) END AS statement FROM trends"""

ORACLES["month_means"] = f"""SELECT 'o_totalprice' AS series, month(o_orderdate) AS period, strftime(any_value(o_orderdate), '%b') AS label,
  {rnd('avg(o_totalprice)', 4)} AS mean FROM orders GROUP BY month(o_orderdate)"""
ORACLES["sink_round_trip"] = f"SELECT m.*, format FROM ({ORACLES['month_means']}) m, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS format)"
_RAW = union([f"SELECT '{c}' AS series, ts, pos, {c} AS y FROM placed" for c in SERIES])
ORACLES["weekday_means"] = f"""WITH {GAPPY} SELECT series, isodow(ts) - 1 AS period, strftime(any_value(ts), '%a') AS label,
  {rnd('avg(y)', 4)} AS mean FROM ({_RAW}) GROUP BY series, isodow(ts) HAVING avg(y) IS NOT NULL"""
LAGGED = FILLED + """,
lagged AS (SELECT series, y, lag(y, 7) OVER w AS l7, lag(y, 12) OVER w AS l12, lag(y, 4) OVER w AS l4 FROM series WINDOW w AS (PARTITION BY series ORDER BY pos)),
rs AS (SELECT series, coalesce(CASE WHEN isfinite(corr(y, l7)) THEN corr(y, l7) END, 0) AS weekly, coalesce(CASE WHEN isfinite(corr(y, l12)) THEN corr(y, l12) END, 0) AS monthly,
    coalesce(CASE WHEN isfinite(corr(y, l4)) THEN corr(y, l4) END, 0) AS quarterly FROM lagged GROUP BY series)"""
ORACLES["lag_correlation"] = f"WITH {LAGGED} " + union(
    [f"SELECT series, '{n}' AS lag_name, CAST({k} AS BIGINT) AS lag, {rnd(n)} AS r FROM rs" for n, k in (("weekly", 7), ("monthly", 12), ("quarterly", 4))]
)
ORACLES["seasonal_class"] = f"""WITH {LAGGED}, top AS (SELECT series, greatest(abs(weekly), abs(monthly), abs(quarterly)) AS m FROM rs)
SELECT series, {rnd('m')} AS max_abs_r, CASE WHEN round(m, 4) >= 0.3 THEN 'seasonal' WHEN round(m, 4) >= 0.15 THEN 'weakly_seasonal' ELSE 'not_seasonal' END AS seasonal_class FROM top"""
ORACLES["calendar_box_stats"] = f"""WITH {GAPPY}, raw AS ({union([f"SELECT '{c}' AS series, ts, {c} AS y FROM placed WHERE {c} IS NOT NULL" for c in ('value', 'cycle')])}),
cells AS (SELECT series, 'month' AS grain, month(ts) AS period, strftime(ts, '%b') AS label, y FROM raw
  UNION ALL SELECT series, 'weekday', isodow(ts) - 1, strftime(ts, '%a'), y FROM raw),
box AS (SELECT series, grain, period, label, count(*) AS n, min(y) AS low, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median,
  quantile_cont(y, 0.75) AS q3, max(y) AS high FROM cells GROUP BY 1, 2, 3, 4)
SELECT b.series, b.grain, b.period, b.label, b.n, round(b.low, 4) AS low, round(b.q1, 4) AS q1, round(b.median, 4) AS median, round(b.q3, 4) AS q3, round(b.high, 4) AS high,
  round(min(c.y) FILTER (c.y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(c.y) FILTER (c.y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high
FROM box b JOIN cells c USING (series, grain, period, label) GROUP BY 1, 2, 3, 4, 5, b.low, b.q1, b.median, b.q3, b.high"""

# level stationarity: bandwidth from the first lag products, then the weighted long-run variance
_TESTED = tuple(SERIES)
LEVEL = FILLED + f""",
dev AS MATERIALIZED (SELECT series, pos, n, y - avg(y) OVER (PARTITION BY series) AS e FROM sized WHERE series IN {_TESTED}),
runs AS (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY pos) AS s FROM dev),
eta AS (SELECT series, any_value(n) AS n, sum(s * s) / (any_value(n) * CAST(any_value(n) AS DOUBLE)) AS eta FROM runs GROUP BY series),
shifted AS (SELECT series, pos + lag AS pos, lag, e FROM dev, (SELECT unnest(range(0, 201)) AS lag)),
g AS MATERIALIZED (SELECT series, s.lag, sum(d.e * s.e) AS g FROM dev d JOIN shifted s USING (series, pos) GROUP BY 1, 2),
width AS (SELECT series, any_value(n) AS n, any_value(eta) AS eta,
    sum(CASE WHEN lag = 0 THEN g ELSE 2 * g END) FILTER (lag <= floor(n ** (2.0 / 9))) AS s0,
    sum(lag * 2 * g) FILTER (lag BETWEEN 1 AND floor(n ** (2.0 / 9))) AS s1 FROM g JOIN eta USING (series) GROUP BY series),
band AS (SELECT *, CAST(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)) AS BIGINT) AS lags FROM width),
level AS (SELECT series, any_value(lags) AS lags, any_value(eta) / (sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (lags + 1.0)) * g END) FILTER (lag <= lags) / any_value(n)) AS st
  FROM g JOIN band USING (series) GROUP BY series),
level_p AS (SELECT *, CASE WHEN st <= 0.347 THEN 0.1 WHEN st <= 0.463 THEN 0.1 - (st - 0.347) / 0.116 * 0.05 WHEN st <= 0.574 THEN 0.05 - (st - 0.463) / 0.111 * 0.025
  WHEN st <= 0.739 THEN 0.025 - (st - 0.574) / 0.165 * 0.015 ELSE 0.01 END AS p FROM level)"""
ORACLES["kpss_test"] = f"WITH {LEVEL} SELECT series, {rnd('st', 5)} AS statistic, {rnd('p', 5)} AS p_value, lags, p > 0.05 AS stationary, CAST(NULL AS VARCHAR) AS reason FROM level_p"

# Dickey-Fuller: normal equations by elimination over lists. Eliminating k regressors leaves the residual sum of
# squares in the last cell, so one elimination scores every lag count; a second one gives the statistic.
def eliminated(name: str, gram: str, stop: str) -> str:
    return f"""{name} AS (
  SELECT series, 0 AS k, {stop} AS stop, mat FROM {gram}
  UNION ALL
  SELECT series, k + 1, stop, list_transform(mat, lambda line, i: list_transform(line, lambda v, j:
    CASE WHEN i > k + 1 AND j > k + 1 THEN v - line[k + 1] * mat[k + 1][j] / mat[k + 1][k + 1] ELSE v END)) FROM {name} WHERE k < stop)"""


def gram(name: str, cells: str) -> str:
    return f"""{name}_cells AS (SELECT a.series, a.v AS i, b.v AS j, sum(a.x * b.x) AS g FROM {cells} a JOIN {cells} b USING (series, t) GROUP BY 1, 2, 3),
{name}_lines AS (SELECT series, i, list(g ORDER BY j) AS line FROM {name}_cells GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT series, list(line ORDER BY i) AS mat FROM {name}_lines GROUP BY series)"""


ADF = f"""RECURSIVE {LEVEL},
step AS MATERIALIZED (SELECT series, pos, n, e / stddev_pop(e) OVER (PARTITION BY series) AS y, CAST(least(n // 2 - 2, ceil(12 * (n / 100.0) ** 0.25)) AS BIGINT) AS m,
  (e - lag(e) OVER (PARTITION BY series ORDER BY pos)) / stddev_pop(e) OVER (PARTITION BY series) AS d FROM dev),
wide_x AS MATERIALIZED (
  SELECT series, pos + j AS t, CASE WHEN j = 0 THEN m + 2 ELSE j + 1 END AS v, d AS x FROM step, (SELECT unnest(range(0, 101)) AS j)
    WHERE j <= m AND pos >= 1 AND pos + j BETWEEN m + 1 AND n - 1
  UNION ALL SELECT series, pos + 1, 1, y FROM step WHERE pos + 1 BETWEEN m + 1 AND n - 1
  UNION ALL SELECT series, pos, 0, 1.0 FROM step WHERE pos BETWEEN m + 1 AND n - 1),
{gram('wide_gram', 'wide_x')},
{eliminated('scan', 'wide_gram', 'len(mat) - 1')},
-- a regressor that adds nothing to those before it: the series explains itself
singular AS MATERIALIZED (SELECT s.series FROM scan s JOIN wide_gram g USING (series) WHERE k < stop AND s.mat[k + 1][k + 1] <= 1e-9 * g.mat[k + 1][k + 1] GROUP BY 1),
scored AS (SELECT series, k - 2 AS p, mat[len(mat)][len(mat)] AS rss, mat[1][1] AS rows FROM scan WHERE k >= 2 AND series NOT IN (SELECT series FROM singular)),
aic AS (SELECT series, p, rows * (ln(2 * pi() * rss / rows) + 1) + 2 * (p + 2) AS aic FROM scored),
chosen AS MATERIALIZED (SELECT series, arg_min(p, aic) AS p FROM aic GROUP BY series),
own_x AS MATERIALIZED (
  SELECT series, pos + j AS t, CASE WHEN j = 0 THEN p + 2 ELSE j END AS v, d AS x FROM step JOIN chosen USING (series), (SELECT unnest(range(0, 101)) AS j)
    WHERE j <= p AND pos >= 1 AND pos + j BETWEEN p + 1 AND n - 1
  UNION ALL SELECT series, pos + 1, p + 1, y FROM step JOIN chosen USING (series) WHERE pos + 1 BETWEEN p + 1 AND n - 1
  UNION ALL SELECT series, pos, 0, 1.0 FROM step JOIN chosen USING (series) WHERE pos BETWEEN p + 1 AND n - 1),
{gram('own_gram', 'own_x')},
{eliminated('solve', 'own_gram', 'len(mat) - 2')},
corner AS (SELECT series, len(mat) - 3 AS p, mat[1][1] AS rows, mat[len(mat) - 1][len(mat) - 1] AS a, mat[len(mat) - 1][len(mat)] AS b, mat[len(mat)][len(mat)] AS c FROM solve WHERE k = stop),
unit AS (SELECT series, p AS lags, b / a / sqrt((c - b * b / a) / (rows - p - 2) / a) AS tau FROM corner),
unit_z AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ** 2 ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ** 2 - 0.010368 * tau ** 3 END AS z FROM unit),
unit_q AS (SELECT series, lags, tau, CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 OR z < -8 THEN 0.0 ELSE
    0.5 + sign(z) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(-0.5 * (abs(z) * i / 2000.0) ** 2))) * abs(z) / 2000.0 / 3 / sqrt(2 * pi()) END AS p FROM unit_z),
unit_p AS (SELECT * FROM unit_q UNION ALL SELECT series, NULL, NULL, NULL FROM singular),
joint AS (SELECT u.series, u.p < 0.05 AS adf_stationary, l.p > 0.05 AS kpss_stationary,
    CASE WHEN u.p IS NULL THEN NULL WHEN u.p < 0.05 AND l.p > 0.05 THEN 'stationary' WHEN u.p < 0.05 THEN 'trend_stationary' WHEN l.p > 0.05 THEN 'difference_stationary' ELSE 'unit_root' END AS verdict
  FROM unit_p u JOIN level_p l USING (series))"""
ORACLES["adf_test"] = f"WITH {ADF} SELECT series, {rnd('tau', 4)} AS statistic, {rnd('p', 4)} AS p_value, lags, p < 0.05 AS stationary, CASE WHEN tau IS NULL THEN 'singular' END AS reason FROM unit_p"
ORACLES["joint_verdict"] = f"WITH {ADF} SELECT series, adf_stationary, kpss_stationary, verdict FROM joint"
ORACLES["stationarity_table"] = f"""WITH {ADF} SELECT series, verdict, CASE verdict WHEN 'stationary' THEN 'none' WHEN 'trend_stationary' THEN 'detrend' WHEN 'unit_root' THEN 'first_difference' WHEN 'difference_stationary' THEN 'first_difference' END
  || CASE WHEN verdict <> 'stationary' AND min(y) > 0 AND stddev_samp(y) / avg(y) > 0.5 THEN ' + log_transform' ELSE '' END AS transform
  FROM joint JOIN sized USING (series) GROUP BY series, verdict"""
ORACLES["recommend_transform"] = ORACLES["stationarity_table"]

# autocorrelation: lag products, then Levinson-Durbin as a recursive query over lists
ACF = "RECURSIVE " + FILLED + """,
dev AS MATERIALIZED (SELECT series, pos, n, y - avg(y) OVER (PARTITION BY series) AS e FROM sized),
g AS (SELECT a.series, CAST(k.lag AS BIGINT) AS lag, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM (SELECT unnest(range(0, 41)) AS lag) k
  JOIN dev a ON k.lag <= least(40, a.n // 2 - 1) JOIN dev b ON b.series = a.series AND b.pos = a.pos - k.lag GROUP BY 1, 2),
acf AS (SELECT series, lag, n, g / max(CASE WHEN lag = 0 THEN g END) OVER (PARTITION BY series) AS acf FROM g),
adj AS (SELECT series, list(acf * n / (n - lag) ORDER BY lag) AS r FROM acf GROUP BY series),
lev AS (
  SELECT series, 1 AS k, r, [r[2]] AS phi FROM adj WHERE abs(r[2]) <= 1
  UNION ALL
  SELECT series, k + 1, r, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - p * phi[k + 1 - j]), p) FROM (
    SELECT *, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) / (1 - list_dot_product(phi, r[2:k + 1])) AS p FROM lev WHERE k + 1 < len(r)
      AND 1 - list_dot_product(phi, r[2:k + 1]) > 1e-9 * (1 + list_dot_product(list_transform(phi, lambda x: abs(x)), list_transform(r[2:k + 1], lambda x: abs(x))))) WHERE abs(p) <= 1),
-- from the lag on that has no partial value, there is none
pacf AS (SELECT series, a.lag, CASE WHEN a.lag = 0 THEN 1.0 ELSE phi[k] END AS pacf FROM acf a LEFT JOIN lev USING (series) WHERE a.lag = 0 AND coalesce(k, 1) = 1 OR k = a.lag
  UNION ALL SELECT series, lag, NULL FROM acf a WHERE lag > 0 AND NOT EXISTS (SELECT 1 FROM lev WHERE lev.series = a.series AND lev.k = a.lag)),
both_ AS (SELECT series, lag, acf, pacf, 1.96 / sqrt(n) AS band, abs(round(acf, 4)) > 1.96 / sqrt(n) AS acf_significant,
  abs(round(pacf, 4)) > 1.96 / sqrt(n) AS pacf_significant FROM acf JOIN pacf USING (series, lag))"""
ORACLES["acf"] = f"WITH {ACF} SELECT series, lag, {rnd('acf')} AS acf FROM acf"
ORACLES["pacf"] = f"WITH {ACF} SELECT series, lag, {rnd('pacf')} AS pacf FROM pacf"
ORACLES["correlogram"] = f"WITH {ACF} SELECT series, lag, {rnd('acf')} AS acf, {rnd('pacf')} AS pacf, {rnd('band')} AS band, acf_significant, pacf_significant FROM both_"
ORACLES["significant_lags"] = f"WITH {ACF} SELECT series, lag, {rnd('acf')} AS acf FROM both_ WHERE lag IN (1, 7, 14, 30) AND acf_significant"
ORACLES["arima_order_hint"] = f"""WITH {ACF}, runs AS (SELECT series,
  coalesce(min(CASE WHEN NOT coalesce(pacf_significant, false) THEN lag END) - 1, max(lag)) AS p, coalesce(min(CASE WHEN NOT acf_significant THEN lag END) - 1, max(lag)) AS q
  FROM both_ WHERE lag >= 1 GROUP BY series) SELECT series, p, q, printf('(%d, d, %d)', p, q) AS hint FROM runs"""
ORACLES["confidence_band"] = f"WITH {GAPPY} " + union([f"SELECT '{c}' AS series, count(*) AS n, {rnd('1.96 / sqrt(count(*))')} AS band FROM gappy" for c in SERIES])
ORACLES["lag_pairs"] = f"""WITH {FILLED}, pairs AS (SELECT series, pos, lag(y) OVER (PARTITION BY series ORDER BY pos) AS x, y FROM series WHERE series IN ('value', 'user_id'))
SELECT series, pos, {rnd('x', 4)} AS y_lag1, {rnd('y', 4)} AS y FROM pairs WHERE pos > 0"""

# --- panels ------------------------------------------------------------------------------------------------

PANEL = """placed AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS v,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
near AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS lp,
    first_value(v IGNORE NULLS) OVER b AS rv, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS rp
  FROM placed WINDOW a AS (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT o_custkey, pos, CASE WHEN v IS NOT NULL THEN v WHEN lp IS NULL THEN rv WHEN rp IS NULL THEN lv ELSE lv + (rv - lv) / (rp - lp) * (pos - lp) END AS y
  FROM near WHERE lp IS NOT NULL OR rp IS NOT NULL)"""
ORACLES["panel_trend"] = f"""WITH {PANEL}, fits AS (SELECT o_custkey, count(*) AS n, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept, regr_r2(y, pos) AS r2,
    arg_min(y, pos) AS "start", arg_max(y, pos) AS "end" FROM filled GROUP BY 1 HAVING count(*) >= 4),
tested AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t, ("end" - "start") / abs("start") * 100 AS pct FROM fits),
judged AS (SELECT *, {t_tail('t', 'n - 2')} AS p FROM tested)
SELECT o_custkey, 'price' AS "column", n, {rnd('slope')} AS slope, {rnd('intercept')} AS intercept, {rnd('r2', 5)} AS r2, {rnd('p', 5)} AS p_value, {rnd('"start"')} AS "start", {rnd('"end"')} AS "end",
  {rnd('pct', 2)} AS pct_change, CASE WHEN abs(pct) > 10 AND p < 0.05 AND pct > 0 THEN 'upward' WHEN abs(pct) > 10 AND p < 0.05 THEN 'downward' ELSE 'stable' END AS direction FROM judged"""
ORACLES["panel_acf"] = f"""WITH {PANEL}, dev AS (SELECT o_custkey, pos, y - avg(y) OVER w AS e, count(*) OVER w AS n FROM filled WINDOW w AS (PARTITION BY o_custkey)),
sums AS (SELECT a.o_custkey, k.lag, sum(a.e * b.e) AS g FROM (SELECT unnest(range(0, 6)) AS lag) k JOIN dev a ON a.n >= 15 AND k.lag <= a.n // 2 - 1
  JOIN dev b ON b.o_custkey = a.o_custkey AND b.pos = a.pos - k.lag GROUP BY 1, 2)
SELECT o_custkey, 'price' AS "column", lag, {rnd('g / max(CASE WHEN lag = 0 THEN g END) OVER (PARTITION BY o_custkey)')} AS acf FROM sums"""
ORACLES["panel_rolling_mean"] = f"""WITH {PANEL} SELECT o_custkey, 'price' AS "column", pos, {rnd('y')} AS y,
  {rnd('avg(y) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_mean FROM filled"""

# --- transforms --------------------------------------------------------------------------------------------

CHANGED = f"""{FILLED}, kept AS (SELECT series, pos, y FROM series UNION ALL SELECT 'positive', pos, user_id + 1 FROM filled)"""
ORACLES["apply_transforms"] = f"""WITH {CHANGED}, lines AS (SELECT regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS base FROM kept WHERE series = 'stepped')
SELECT series, pos, {rnd("""CASE series WHEN 'value' THEN y - lag(y) OVER w WHEN 'cycle' THEN y - lag(y, 7) OVER w WHEN 'positive' THEN ln(y / lag(y) OVER w) WHEN 'stepped' THEN y - base - slope * pos ELSE y END""", 5)} AS value
FROM kept, lines WINDOW w AS (PARTITION BY series ORDER BY pos)"""
ORACLES["transform_round_trip"] = f"WITH {CHANGED} SELECT series, pos, {rnd('y', 5)} AS y FROM kept"

# --- forecasts ---------------------------------------------------------------------------------------------


def _walk(key: str, horizon: int, every: int, first: int, season: int, window: int, train_rows: int | None = None) -> str:
    """Forecasts from every origin of ``long`` (key, pos, y), each fitted by a scan of its own."""
    since = f"AND l.pos > origin - {train_rows}" if train_rows else ""
    return f"""ends AS (SELECT {key}, max(pos) AS last FROM long GROUP BY 1),
origins AS (SELECT {key}, pos AS origin FROM long JOIN ends USING ({key}) WHERE pos >= {first} AND (pos - {first}) % {every} = 0 AND pos < last),
known AS (SELECT {key}, origin, arg_max(y, l.pos) FILTER (y IS NOT NULL) AS naive, avg(y) FILTER (l.pos > origin - {window}) AS moving_average FROM origins JOIN long l USING ({key}) WHERE l.pos <= origin GROUP BY 1, 2),
lines AS (SELECT {key}, origin, regr_slope(y, l.pos) AS slope, regr_intercept(y, l.pos) AS base FROM origins JOIN long l USING ({key}) WHERE l.pos <= origin {since} GROUP BY 1, 2),
walked AS (SELECT o.{key}, o.origin, a.pos - o.origin AS step, a.pos, a.y AS actual, k.naive, s.y AS seasonal_naive, k.moving_average, base + slope * a.pos AS linear
  FROM origins o JOIN long a ON a.{key} = o.{key} AND a.pos BETWEEN o.origin + 1 AND o.origin + {horizon} AND a.y IS NOT NULL
  JOIN known k ON k.{key} = o.{key} AND k.origin = o.origin LEFT JOIN lines f ON f.{key} = o.{key} AND f.origin = o.origin
  LEFT JOIN long s ON s.{key} = o.{key} AND s.pos = a.pos - {season} * ((a.pos - o.origin + {season} - 1) // {season}))"""


_METHODS = ("naive", "seasonal_naive", "moving_average", "linear")


def _errors(keys: str) -> str:
    return union([
        f"SELECT {keys}, '{m}' AS method, count({m}) AS n, {rnd(f'avg({m} - actual)', 5)} AS bias, {rnd(f'avg(abs({m} - actual))', 5)} AS mae, {rnd(f'sqrt(avg(({m} - actual) ** 2))', 5)} AS rmse, "
        f"{rnd(f'100 * avg(CASE WHEN actual <> 0 THEN abs({m} - actual) / abs(actual) END)', 5)} AS mape, count(CASE WHEN actual = 0 AND {m} IS NOT NULL THEN 1 END) AS n_zero FROM walked GROUP BY ALL"
        for m in _METHODS
    ])


def _long(names: tuple) -> str:
    return f"{GAPPY}, long AS (" + union([f"SELECT '{c}' AS series, pos, {c} AS y FROM placed" for c in names]) + ")"


ORACLES["rolling_origin"] = f"WITH {_long(('value', 'cycle', 'stepped'))}, {_walk('series', 10, 100, 14, 7, 7)} {_errors('series, step')}"
ORACLES["rolling_origin_sliding"] = f"WITH {_long(('value', 'stepped'))}, {_walk('series', 5, 40, 20, 3, 5, 50)} SELECT series, origin, step, pos, " + ", ".join(
    f"{rnd(c, 5)} AS {c}" for c in ("actual", *_METHODS)) + " FROM walked"
ORACLES["panel_forecast_errors"] = f"""WITH {PANEL}, long AS (SELECT o_custkey, pos, ln(v) AS y FROM placed), {_walk('o_custkey', 2, 1, 3, 2, 3)} {_errors("o_custkey, 'log_price' AS " + '"column"')}"""
ORACLES["baseline_forecast"] = f"""WITH {_long(('value', 'cycle', 'stepped'))}, ends AS (SELECT series, max(pos) AS last, arg_max(y, pos) FILTER (y IS NOT NULL) AS naive,
    regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS base FROM long GROUP BY 1),
ahead AS (SELECT *, last + step AS pos FROM ends, (SELECT unnest(range(1, 11)) AS step))
SELECT a.series, step, a.pos, {rnd('naive', 5)} AS naive, {rnd('s.y', 5)} AS seasonal_naive, (SELECT {rnd('avg(y)', 5)} FROM long l WHERE l.series = a.series AND l.pos > last - 7) AS moving_average,
  {rnd('base + slope * a.pos', 5)} AS linear FROM ahead a LEFT JOIN long s ON s.series = a.series AND s.pos = a.pos - 7 * ((step + 6) // 7)"""

# the tail of chi-square with ten degrees of freedom has a closed form; that of the normal by Simpson's rule
ORACLES["residual_diagnostics"] = f"""WITH {FILLED}, lines AS (SELECT series, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS base FROM series GROUP BY 1),
left_over AS (SELECT series, pos, CASE WHEN series IN ('value', 'cycle') THEN y - lag(y) OVER (PARTITION BY series ORDER BY pos) ELSE y - base - slope * pos END AS e FROM series JOIN lines USING (series)),
centred AS (SELECT *, e - avg(e) OVER w AS d, count(*) OVER w AS n FROM left_over WHERE e IS NOT NULL WINDOW w AS (PARTITION BY series)),
lagged AS (SELECT a.series, k.lag, any_value(a.n) AS n, sum(a.d * b.d) AS g FROM (SELECT unnest(range(0, 11)) AS lag) k JOIN centred a ON TRUE JOIN centred b ON b.series = a.series AND b.pos = a.pos - k.lag GROUP BY 1, 2),
box AS (SELECT series, n * (n + 2) * sum(CASE WHEN lag > 0 THEN g * g / (n - lag) END) / max(CASE WHEN lag = 0 THEN g END) ** 2 AS q FROM lagged GROUP BY series, n),
runs AS (SELECT series, count(*) AS n, avg(e) AS bias, avg(e) / stddev_samp(e) * sqrt(count(*)) AS t, CAST(count(CASE WHEN e >= 0 THEN 1 END) AS DOUBLE) AS u, 1 + count(CASE WHEN turned THEN 1 END) AS runs FROM (
  SELECT *, (e >= 0) <> lag(e >= 0) OVER (PARTITION BY series ORDER BY pos) AS turned FROM left_over WHERE e IS NOT NULL) GROUP BY 1),
expected AS (SELECT *, 2 * u * (n - u) / n AS m FROM runs),
scored AS (SELECT *, (runs - m - 1) / sqrt(m * (m - 1) / (n - 1)) AS z FROM expected JOIN box USING (series)),
tails AS (SELECT *, {t_tail('t', 'n - 1')} AS bp, exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24) AS qp,
  CASE WHEN abs(z) > 30 THEN 0.0 ELSE greatest(0.0, 1 - 2 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * exp(-0.5 * (abs(z) * i / 4000.0) ** 2))) * abs(z) / 12000.0 / sqrt(2 * pi())) END AS zp FROM scored)
SELECT series, n, {rnd('bias', 5)} AS bias, {rnd('bp', 5)} AS bias_p, {rnd('q', 5)} AS ljung_box, {rnd('qp', 5)} AS ljung_box_p, runs, {rnd('z', 5)} AS runs_z, {rnd('zp', 5)} AS runs_p,
  bp >= 0.05 AND qp >= 0.05 AND zp >= 0.05 AS white_noise FROM tails"""

# --- drift -------------------------------------------------------------------------------------------------

SHIPPED = """shipped AS (SELECT *, l_extendedprice * CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 1.2 ELSE 1.0 END AS price, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_discount END AS hot,
  CAST(1 AS DOUBLE) AS fixed, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN l_tax END AS past,
  CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' AND l_linenumber = 1 THEN 'moved' ELSE l_linestatus END AS status, l_shipdate >= TIMESTAMP '1998-06-01' AS late FROM lineitem WHERE l_orderkey % 11 <> 0)"""
_SHIFT = "CASE WHEN psi >= 0.25 THEN 'large' WHEN psi >= 0.1 THEN 'moderate' WHEN psi IS NOT NULL THEN 'stable' END AS shift"
# the tail of the distance by the theta form of its distribution
_TAIL = """1 - sqrt(2 * pi()) / z * list_sum(list_transform(range(1, 400), lambda k: exp(-((2 * k - 1) ** 2) * pi() ** 2 / (8 * z * z))))"""
ORACLES["numeric_drift"] = f"WITH {SHIPPED}, long AS (" + union(
    [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, late FROM shipped WHERE {c} IS NOT NULL" for c in ("l_quantity", "price", "l_orderkey", "hot", "fixed", "past")]
) + f"""), steps AS (SELECT "column", count(CASE WHEN NOT late THEN 1 END) OVER up AS a, count(CASE WHEN late THEN 1 END) OVER up AS b, count(CASE WHEN NOT late THEN 1 END) OVER w AS na,
    count(CASE WHEN late THEN 1 END) OVER w AS nb, late, count(CASE WHEN NOT late THEN 1 END) OVER (PARTITION BY "column" ORDER BY v GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
  FROM long WINDOW up AS (PARTITION BY "column" ORDER BY v), w AS (PARTITION BY "column")),
largest AS (SELECT "column", any_value(na) AS na, any_value(nb) AS nb, max(abs(a / na - b / nb)) AS d FROM steps GROUP BY 1),
cells AS (SELECT l."column", k.bin, l.na, l.nb, greatest(count(CASE WHEN NOT late THEN 1 END), 0.5) / greatest(l.na, 5) AS p, greatest(count(late) FILTER (late), 0.5) / greatest(l.nb, 5) AS q
  FROM largest l CROSS JOIN (SELECT unnest(range(0, 10)) AS bin) k LEFT JOIN steps s ON s."column" = l."column" AND least(9, 10 * below // s.na) = k.bin WHERE l.nb > 0 AND l.na > 0 GROUP BY 1, 2, 3, 4 HAVING count(s.late) > 0),
indexed AS (SELECT "column", sum((q - p) * ln(q / p)) AS psi FROM cells GROUP BY 1),
scaled AS (SELECT *, sqrt(na * nb / (na + nb)) AS e FROM largest LEFT JOIN indexed USING ("column")),
tested AS (SELECT *, CASE WHEN nb > 0 AND na > 0 THEN (e + 0.12 + 0.11 / e) * d END AS z FROM scaled)
SELECT "column", na AS n_reference, nb AS n_current, CASE WHEN z IS NOT NULL THEN {rnd('d')} END AS ks, CASE WHEN z < 0.2 THEN 1.0 WHEN z IS NOT NULL THEN {rnd(f'least(1.0, greatest(0.0, {_TAIL}))')} END AS p_value,
  {rnd('psi')} AS psi, {_SHIFT} FROM tested"""
ORACLES["category_drift"] = f"WITH {SHIPPED}, long AS (" + union([f"SELECT '{c}' AS \"column\", {c} AS v, late FROM shipped WHERE {c} IS NOT NULL" for c in ("l_returnflag", "status")]) + f"""),
counts AS (SELECT "column", v, count(CASE WHEN NOT late THEN 1 END) AS a, count(CASE WHEN late THEN 1 END) AS b FROM long GROUP BY 1, 2),
sized AS (SELECT *, sum(a) OVER w AS na, sum(b) OVER w AS nb, count(*) OVER w AS k FROM counts WINDOW w AS (PARTITION BY "column")),
shares AS (SELECT *, greatest(a, 0.5) / greatest(na, k / 2) AS p, greatest(b, 0.5) / greatest(nb, k / 2) AS q FROM sized)
SELECT "column", CAST(na AS BIGINT) AS n_reference, CAST(nb AS BIGINT) AS n_current, k AS n_categories, {rnd('psi')} AS psi, {rnd('tv')} AS total_variation, {_SHIFT}
FROM (SELECT "column", na, nb, k, sum((q - p) * ln(q / p)) AS psi, sum(abs(a / na - b / nb)) / 2 AS tv FROM shares GROUP BY 1, 2, 3, 4)"""

# --- streams -----------------------------------------------------------------------------------------------

# a part's watermark is a day behind the latest time of the parts before it, in milliseconds; a window that ends by then takes no more rows
STREAM = f"""{FLAWED}, dated AS (SELECT * REPLACE (CASE WHEN event_id % 97 <> 0 THEN ts END AS ts) FROM dirty),
timed AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) + CASE WHEN event_id % 20 = 0 THEN 259200000000 ELSE 0 END AS arrival FROM dated),
parted AS (SELECT *, coalesce((arrival - (SELECT min(arrival) FROM timed)) * 4 // ((SELECT max(arrival) - min(arrival) FROM timed) + 1), 0) AS part,
  us // 86400000000 AS step FROM timed),
marks AS (SELECT p.part, (SELECT max(us) // 1000 * 1000 - 86400000000 FROM parted e WHERE e.part < p.part) AS mark FROM (SELECT DISTINCT part FROM parted) p),
judged AS (SELECT e.*, CASE WHEN us IS NULL THEN 'undated' WHEN (step + 1) * 86400000000 <= (SELECT max(us) // 1000 * 1000 - 86400000000 FROM parted) THEN 'closed' ELSE 'open' END AS state,
  coalesce((step + 1) * 86400000000 <= mark, FALSE) AS late FROM parted e JOIN marks USING (part))"""
_DAY = "make_timestamp(step * 86400000000)"


def _streamed(c: str, numeric: bool) -> str:
    v = f"CAST({c} AS DOUBLE)"
    moments = (("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("min", f"min({v})"), ("max", f"max({v})"), ("skewness", f"skewness({v})"), ("kurtosis", f"kurtosis({v})"))
    # moments of a constant column: 0 where the sample is large enough
    least = {"std": 2, "skewness": 3, "kurtosis": 4}
    each = ", ".join(
        (f"CASE WHEN count({c}) >= {least[k]} THEN CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE {rnd(e, 5)} END END" if k in least else rnd(e, 5)) + f' AS "{k}"'
        for k, e in moments
    ) if numeric else ", ".join(f'CAST(NULL AS DOUBLE) AS "{k}"' for k, _ in moments)
    return f"""SELECT {_DAY} AS window_start, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing, {rnd(f"100.0 * (count(*) - count({c})) / count(*)", 5)} AS missing_pct,
  100.0 * (count(*) - count({c})) / count(*) > 40 AS high_missing, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS "constant", {each}
  FROM judged WHERE state = 'closed' AND NOT late GROUP BY step"""


ORACLES["stream_profile"] = f"WITH {STREAM} " + union([_streamed(c, c != "event_type") for c in ("value", "event_type", "step", "sparse", "empty")])
ORACLES["stream_arrivals"] = f"""WITH {STREAM} SELECT {_DAY} AS window_start, state, count(*) AS arrived, CASE WHEN state = 'closed' THEN count(CASE WHEN NOT late THEN 1 END) END AS kept,
  count(CASE WHEN late THEN 1 END) AS late FROM judged GROUP BY step, state"""

# --- segments ----------------------------------------------------------------------------------------------

ORACLES["usable_segments"] = "SELECT * FROM (" + union(
    [f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders" for i, c in enumerate(("o_orderstatus", "o_orderpriority"))]
) + ") WHERE n_distinct BETWEEN 2 AND 20"
ORACLES["segment_stats"] = union(
    [f"SELECT '{g}' AS cat_col, {g} AS cat, '{m}' AS num_col, {rnd(f'avg({m})', 4)} AS mean, {rnd(f'stddev_samp({m})', 4)} AS std, count({m}) AS n, "
     f"{rnd(f'quantile_cont({m}, 0.5)', 4)} AS median FROM lineitem GROUP BY {g}"
     for g in ("l_returnflag", "l_linestatus") for m in ("l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
)
ORACLES["segment_stats_by_customer"] = union(
    [f"SELECT 'o_custkey' AS cat_col, CAST(o_custkey AS VARCHAR) AS cat, '{m}' AS num_col, {rnd(f'avg({m})')} AS mean, {rnd(f'stddev_samp({m})')} AS std, count({m}) AS n, "
     f"{rnd(f'quantile_cont({m}, 0.5)')} AS median FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey" for m in ("o_totalprice", "o_orderkey")]
)
ORACLES["approximate_quartiles"] = union(
    [f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, count({c}) AS n, TRUE AS is_value, TRUE AS within_error FROM lineitem"
     for c in ("l_quantity", "l_extendedprice", "l_tax", "l_orderkey") for p in (0.25, 0.5, 0.75)]
)
_SCORES = "cells AS (" + union(
    [f"SELECT '{g}' AS cat_col, '{m}' AS num_col, {i} AS i, {j} AS j, {g} AS cat, avg({m}) AS mean, var_samp({m}) AS v, count({m}) AS n FROM orders GROUP BY {g} HAVING count({m}) >= 2"
     for i, g in enumerate(("o_orderstatus", "o_orderpriority")) for j, m in enumerate(("o_custkey", "o_totalprice"))]
) + """), centred AS (SELECT *, mean - sum(n * mean) OVER w / sum(n) OVER w AS d FROM cells WINDOW w AS (PARTITION BY cat_col, num_col)),
parts AS (SELECT cat_col, num_col, i, j, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2, sum(n * d * d) AS ssb, sum((n - 1) * v) AS ssw FROM centred GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
scores AS (SELECT *, ssb / df1 / (ssw / df2) AS f FROM parts)"""
ORACLES["anova"] = f"WITH {_SCORES} SELECT cat_col, num_col, df1, df2, {rnd('f')} AS f_stat, {rnd(f_tail('f', 'df1', 'df2'))} AS p_value, ssw = 0 AS degenerate FROM scores"
ORACLES["top_grouping"] = f"WITH {_SCORES} SELECT cat_col AS top_grouping, {rnd('f')} AS f_stat FROM scores WHERE f > 0 ORDER BY f DESC, i, j LIMIT 1"
ORACLES["top_bottom_segments"] = """WITH bars AS (SELECT p_brand AS cat, avg(p_size) AS mean, count(p_size) AS n FROM part GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY mean DESC, cat) AS d, row_number() OVER (ORDER BY mean, cat DESC) AS u FROM bars)
SELECT 'top' AS side, d AS place, cat, round(mean, 4) AS mean, n FROM ranked WHERE d <= 5
UNION ALL SELECT 'bottom', u, cat, round(mean, 4), n FROM ranked WHERE u <= 5"""
ORACLES["segment_mean_bars"] = "SELECT c_mktsegment AS cat, round(avg(c_acctbal), 4) AS mean, count(c_acctbal) AS n FROM customer GROUP BY 1"
ORACLES["kpis"] = f"""WITH {FLAWED}, {STATS} SELECT count(*) AS rows, CAST(9 AS BIGINT) AS columns, (SELECT count(*) FROM trends) AS trends,
  round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))) / count(*), 6) AS duplicate_pct,
  strftime(min(ts), '%b %Y') AS first_month, strftime(max(ts), '%b %Y') AS last_month FROM dirty"""

# --- findings ----------------------------------------------------------------------------------------------

ORACLES["preview"] = "SELECT * FROM events LIMIT 20"
ORACLES["stage_status"] = union(
    [f"SELECT '{s}' AS stage, true AS ok, CAST(NULL AS VARCHAR) AS error" for s in ("profile", "quality", "exploration", "relationships", "causality", "segments", "key figures", "findings")]
)
_EVENT_ACTIONS = f"""WITH {ADF}{STATS[len(FILLED):]},
kinds AS (SELECT j.series, spreads.o, CASE verdict WHEN 'trend_stationary' THEN 'detrend' WHEN 'unit_root' THEN 'difference' WHEN 'difference_stationary' THEN 'difference' END AS kind FROM joint j JOIN spreads USING (series)),
placed_kinds AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o) AS r FROM kinds WHERE kind IS NOT NULL),
listed AS (SELECT string_agg(series, ', ' ORDER BY o) FILTER (kind = 'difference') AS d, string_agg(series, ', ' ORDER BY o) FILTER (kind = 'detrend') AS t FROM placed_kinds WHERE r <= 2),
falling AS (SELECT arg_min(series, ordinal) AS f FROM trends WHERE direction = 'downward'),
rest AS (SELECT CASE WHEN f IS NOT NULL THEN 'Find what makes ' || f || ' fall' ELSE 'Run the report again on newer rows' END AS action FROM falling)
SELECT 'events' AS source, coalesce(nullif(concat_ws('; ', 'Model changes of ' || d || ', not levels', 'Take the trend out of ' || t || ' before modelling'), ''), action) AS action FROM listed, rest
UNION ALL SELECT 'events at rest', action FROM rest"""
ORACLES["recommended_action"] = f"""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS y FROM orders),
fit AS (SELECT count(*) AS n, regr_slope(y, pos) AS slope, regr_r2(y, pos) AS r2, arg_min(y, pos) AS a, arg_max(y, pos) AS b FROM o),
judged AS (SELECT *, sign(slope) * sqrt(r2) * sqrt((n - 2) / (1 - r2)) AS t FROM fit)
SELECT 'orders' AS source, CASE WHEN (b - a) / abs(a) * 100 < -10 AND {t_tail('t', 'n - 2')} < 0.05 THEN 'Find what makes o_totalprice fall'
  ELSE 'Run the report again on newer rows' END AS action FROM judged UNION ALL SELECT * FROM ({_EVENT_ACTIONS})"""
ORACLES["business_findings"] = """WITH size AS (SELECT count(*) AS n FROM customer),
copies AS (SELECT (SELECT n FROM size) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS d),
link AS (SELECT round(corr(c_nationkey, c_acctbal), 3) AS r FROM customer),
cells AS (SELECT c_mktsegment, avg(c_nationkey) AS m1, avg(c_acctbal) AS m2 FROM customer GROUP BY 1 HAVING count(*) >= 2),
split AS (SELECT count(*) AS k, var_pop(m1) + var_pop(m2) AS v FROM cells)
SELECT * FROM (
  SELECT 1 AS ord, 'business' AS section, format('{:,} records of 5 fields', n) AS message FROM size
  UNION ALL SELECT 2, 'business', format('{:,} records repeat another one ({:.1f}%)', d, 100.0 * d / n) FROM copies, size WHERE d > 0
  UNION ALL SELECT 4, 'business', 'Groups differ most by c_mktsegment' FROM split WHERE k BETWEEN 2 AND 20 AND v > 0
  UNION ALL SELECT 5, 'business', printf('Closest pair: c_nationkey ~ c_acctbal, r %.2f', r) FROM link WHERE r IS NOT NULL
  UNION ALL SELECT 6, 'business', 'Next step: ' || CASE WHEN abs(r) >= 0.7 THEN 'Have someone who knows the field explain the strong pairs'
    ELSE 'Start from the groups with the highest and lowest means' END FROM link)"""

_CLEAN = "CASE WHEN event_id % 10 <> 0 THEN value END AS value"


def clean(cte: str, select: str) -> str:
    """A subquery over the two measures of the untouched events table."""
    return f"(WITH {cte.replace(_CLEAN, 'value')} {select})"


_PAIR = "('user_id', 'value')"
ORACLES["technical_findings"] = f"""WITH size AS (SELECT count(*) AS n FROM events),
copies AS (SELECT (SELECT n FROM size) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS d),
long AS (SELECT 'user_id' AS c, CAST(user_id AS DOUBLE) AS v FROM events UNION ALL SELECT 'value', value FROM events),
fence AS (SELECT c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY c),
outside AS (SELECT count(DISTINCT c) AS k FROM long JOIN fence USING (c) WHERE q3 <> q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))),
link AS (SELECT round(corr(user_id, value), 3) AS r FROM events),
moves AS (SELECT count(*) FILTER (direction = 'upward') AS up, count(*) FILTER (direction = 'downward') AS down, count(*) AS k,
  string_agg(series, ', ' ORDER BY ordinal) FILTER (structural_break) AS broken FROM {clean(STATS, f"SELECT * FROM trends WHERE series IN {_PAIR}")}),
verdicts AS (SELECT count(*) FILTER (verdict = 'stationary') AS good, count(*) AS k, string_agg(series, ', ' ORDER BY series) FILTER (verdict <> 'stationary') AS moving
  FROM {clean(ADF, f"SELECT * FROM joint WHERE series IN {_PAIR}")}),
cycles AS (SELECT count(*) FILTER (round(m, 4) >= 0.3) AS hits, count(*) AS k FROM {clean(LAGGED, f"SELECT greatest(abs(weekly), abs(monthly), abs(quarterly)) AS m FROM rs WHERE series IN {_PAIR}")}),
echoes AS (SELECT string_agg(DISTINCT series, ', ' ORDER BY series) AS names FROM {clean(ACF, f"SELECT series FROM both_ WHERE lag IN (1, 7, 14, 30) AND acf_significant AND series IN {_PAIR}")})
SELECT ord, 'technical' AS section, message FROM (
  SELECT 1 AS ord, format('Table of type time series: {{:,}} rows, 6 columns', n) AS message FROM size
  UNION ALL SELECT 2, format('Rows that repeat an earlier one: {{:,}}', d) FROM copies WHERE d > 0
  UNION ALL SELECT 4, printf('Columns with values beyond the quartile fences: %d', k) FROM outside WHERE k > 0
  UNION ALL SELECT 5, printf('Largest coefficient: user_id ~ value, r %.3f', r) FROM link
  UNION ALL SELECT 6, 'Pairs at the strong level: 1; none of them proves a cause' FROM link WHERE abs(r) >= 0.7
  UNION ALL SELECT 7, printf('Direction over time: %d up, %d down, %d in all', up, down, k) FROM moves WHERE k > 0
  UNION ALL SELECT 8, 'Mean shifts at half time: ' || broken FROM moves WHERE broken IS NOT NULL
  UNION ALL SELECT 9, printf('Series that both tests call stationary: %d of %d', good, k) FROM verdicts WHERE k > 0
  UNION ALL SELECT 10, 'Series that they do not: ' || moving FROM verdicts WHERE moving IS NOT NULL
  UNION ALL SELECT 11, printf('Series with a season: %d of %d', hits, k) FROM cycles WHERE hits > 0
  UNION ALL SELECT 12, 'Echo at a reported lag: ' || names FROM echoes WHERE names IS NOT NULL)"""
