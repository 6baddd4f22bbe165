"""The routed analysis: profile, quality, exploration, then sequence or segment stages, then findings."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sondeo.operators import autocorrelation, causal, eda, quality, report, seasonality, segments, stationarity, trend
from sondeo.operators.profile import Profile, build_profile, missing_profile, profile_summary, profile_table
from sondeo.plans.scratch import stored
from sondeo.plans.sequence import Sequence, tie_break, time_order
from sondeo.sources import normalize

log = logging.getLogger(__name__)

Check = Callable[[DataFrame, Profile], DataFrame]
Tables = dict[str, Callable[[], DataFrame]]
# Independent tables of a stage are submitted together, so their jobs share the cluster.
CONCURRENT_TABLES = 4
_checks: dict[str, Check] = {}


def register_check(name: str, check: Check) -> None:
    """Add a user check; it runs after the universal stages and its table joins the results."""
    _checks[name] = check


def unregister_check(name: str) -> None:
    _checks.pop(name, None)


@dataclass
class Analysis:
    profile: Profile | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    status: list[tuple[str, bool, str | None]] = field(default_factory=list)
    sequence: Sequence | None = None

    def stage_status(self, spark) -> DataFrame:
        return spark.createDataFrame(self.status, "stage string, ok boolean, error string")

    def text(self) -> str:
        """The business findings, one per line."""
        rows = self.results["business_findings"].orderBy("ord").collect() if "business_findings" in self.results else []
        return "\n".join(r["message"] for r in rows)


def analyze(
    df: DataFrame, max_trend_columns: int | None = trend.MAX_COLUMNS, store: bool = True, store_input: bool = False
) -> Analysis:
    """Run every stage that suits the table. A failing stage is recorded and its tables stay out of the rest.

    Each stage's result tables are small and stored as they are made, so findings read results, not data. The
    stages scan the input several times: pass ``store_input`` when it is a costly query and not a table.
    """
    out = Analysis()
    spark = df.sparkSession
    df = normalize(df)  # NaN is missing, whatever the frame came from
    df = stored(df, "input") if store_input else df

    def stage(name: str, build: Callable[[], Tables]) -> None:
        def run(item):
            key, make = item
            return key, stored(make(), key) if store else make()

        try:
            with ThreadPoolExecutor(CONCURRENT_TABLES) as pool:
                tables = dict(pool.map(run, build().items()))
        except Exception as error:  # noqa: BLE001 - a stage must not stop the run
            log.warning("stage %s failed: %s", name, error)
            out.status.append((name, False, str(error).split("\n")[0]))
            return
        out.results.update(tables)
        out.status.append((name, True, None))

    def run_profile() -> Tables:
        p = build_profile(df)
        out.profile = p
        return {
            "profile": lambda: profile_table(df, p), "summary": lambda: profile_summary(df, p),
            "missing_profile": lambda: missing_profile(df),
        }

    stage("profile", run_profile)
    p = out.profile or Profile(columns=df.columns, kinds={})
    stage("quality", lambda: {
        "duplicate_rows": lambda: quality.duplicate_rows(df), "high_missing": lambda: quality.high_missing(df),
        "constant_columns": lambda: quality.constant_columns(df),
        "high_cardinality": lambda: quality.high_cardinality(df, profile=p),
        "iqr_outliers": lambda: quality.iqr_outliers(df, profile=p),
        "case_inconsistency": lambda: quality.case_inconsistency(df, profile=p),
    })
    stage("exploration", lambda: {
        "univariate": lambda: eda.univariate(df, profile=p), "describe": lambda: eda.describe(df, profile=p),
        "most_skewed": lambda: eda.most_skewed(df, profile=p), "histogram": lambda: eda.histogram(df, profile=p), "top_correlations": lambda: eda.top_correlations(df, profile=p),
        "pearson_matrix": lambda: eda.pearson_matrix(df, profile=p), "spearman_matrix": lambda: eda.spearman_matrix(df, profile=p),
        "mutual_information": lambda: eda.mutual_information(df, profile=p),
        "categorical_cardinality": lambda: eda.categorical_cardinality(df, profile=p),
    })
    if "top_correlations" in out.results:
        stage("relationships", lambda: {"relationship_statements": lambda: report.relationship_statements(out.results["top_correlations"])})
    stage("causality", lambda: {
        "correlation_warnings": lambda: causal.correlation_warnings(df, profile=p, pairs=out.results.get("top_correlations")),
        "binary_treatment": lambda: causal.binary_treatment(df, profile=p),
    })
    for name, check in list(_checks.items()):
        stage(name, lambda check=check, name=name: {name: lambda: check(df, p)})

    if p.ordered:
        _sequence_stages(df, p, out, stage, max_trend_columns)
    else:
        _segment_stages(df, p, out, stage)
    if "duplicate_rows" in out.results:
        trends = out.results["trend_table"].count() if "trend_table" in out.results else 0
        when = p.when(df) if p.date_column else None
        stage("key figures", lambda: {"kpis": lambda: report.kpis(df, when, trends, out.results["duplicate_rows"])})
    stage("findings", lambda: {
        "technical_findings": lambda: report.technical_findings(p, spark, out.results),
        "business_findings": lambda: report.business_findings(p, spark, out.results),
    })
    return out


def _sequence_stages(df: DataFrame, p: Profile, out: Analysis, stage, max_trend_columns: int) -> None:
    def order() -> Tables:
        out.sequence = time_order(df, p.when(df), p.measures, tie_break(df, p.date_column))
        out.sequence.fill()
        return {}

    stage("time_order", order)
    seq = out.sequence
    if seq is None:
        return
    chosen = trend.trend_columns(seq, max_trend_columns)
    stage("trend", lambda: {
        "trend_table": lambda: trend.trend_table(seq, chosen), "rolling_window": lambda: trend.infer_rolling_window(seq),
        "ols_fitted_line": lambda: trend.ols_fitted_line(seq, chosen), "break_marker": lambda: trend.break_marker(seq, chosen),
    })
    if "rolling_window" in out.results:
        stage("statements", lambda: {
            "trend_statements": lambda: report.trend_statements(out.results["trend_table"]),
            "rolling_mean": lambda: trend.rolling_mean(seq, out.results["rolling_window"].first()["rolling_window"], chosen),
        })
    stage("seasonality", lambda: {
        "month_means": lambda: seasonality.month_means(seq), "weekday_means": lambda: seasonality.weekday_means(seq),
        "lag_correlation": lambda: seasonality.lag_correlation(seq), "seasonal_class": lambda: seasonality.seasonal_class(seq),
        "calendar_box_stats": lambda: seasonality.calendar_box_stats(seq),
    })
    stage("stationarity", lambda: {"stationarity_table": lambda: stationarity.stationarity_table(seq)})

    def lags() -> Tables:
        table = stored(autocorrelation.correlogram(seq), "correlogram")
        return {
            "correlogram": lambda: table,
            "significant_lags": lambda: autocorrelation.significant_lags(seq, acf_values=table),
            "arima_order_hint": lambda: autocorrelation.arima_order_hint(seq, lags=table),
            "lag_pairs": lambda: autocorrelation.lag_pairs(seq),
        }

    stage("autocorrelation", lags)


def _segment_stages(df: DataFrame, p: Profile, out: Analysis, stage) -> None:
    def compare() -> Tables:
        groupings = segments.segment_names(df, profile=p)
        if not groupings or not p.measures:
            return {}
        scores = stored(segments.anova(df, groupings, p.measures), "anova")
        best = segments.top_grouping(df, groupings, p.measures, scores)
        tables: Tables = {
            "segment_stats": lambda: segments.segment_stats(df, groupings, p.measures), "anova": lambda: scores,
            "top_grouping": lambda: best,
        }
        top = best.first()
        if top is not None:
            tables["top_bottom_segments"] = lambda: segments.top_bottom_segments(df, top["top_grouping"], p.measures[0])
            tables["segment_mean_bars"] = lambda: segments.segment_mean_bars(df, top["top_grouping"], p.measures[0])
        return tables

    stage("segments", compare)
