"""Positions, gaps and lags inside each entity of a panel, against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeo.operators import panel as ops
from sondeo.plans.panel import panel_order

START = dt.datetime(2024, 1, 1)
SCHEMA = "entity string, part int, at timestamp_ntz, tie int, y double, pos double"


def rows_of():
    rng = random.Random(4)
    rows = []
    for i in range(400):  # a third of all rows is one entity
        rows.append(("hot", 1, START + dt.timedelta(hours=rng.randrange(200)), i, rng.random() if i % 7 else None, 1.0))
    for e in range(60):
        for i in range(rng.randrange(1, 24)):
            rows.append((f"e{e}" if e else None, e % 2, START + dt.timedelta(days=rng.randrange(15)), i, None if e == 5 else 3.0 if e == 6 else rng.random() if rng.random() < 0.8 else None, 1.0))
    rows += [("hot", 1, None, 9, 5.0, 1.0), ("e3", 1, None, 9, 5.0, 1.0), ("dateless", 0, None, 1, 1.0, 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wanted():
    pdf = pd.DataFrame(rows_of(), columns=["entity", "part", "at", "tie", "y", "pos"]).dropna(subset=["at"])
    pdf["entity"] = [e if isinstance(e, str) else "" for e in pdf["entity"]]
    pdf = pdf.sort_values(["entity", "part", "at", "tie"])
    pdf["pos"] = pdf.groupby(["entity", "part"]).cumcount()
    pdf["filled"] = pdf.groupby(["entity", "part"])["y"].transform(lambda s: s.interpolate(limit_direction="both"))
    return pdf


def made(frame, **options):
    return panel_order(frame, ["entity", "part"], F.col("at"), ["y", "pos"], [F.col("tie")], **options)


@pytest.mark.parametrize("partitions", [1, 3, 40, 200])
def test_positions_over_partitions(frame, wanted, partitions):
    panel = made(frame, partitions=partitions)
    got = {(r.entity or "", r.part, r.pos): (r.ts, r.y) for r in panel.table.collect()}
    want = {(e, p, i): (t.to_pydatetime(), None if pd.isna(y) else y) for e, p, i, t, y in wanted[["entity", "part", "pos", "at", "y"]].itertuples(index=False)}
    assert got == want and panel.dropped_null_dates == 3


@pytest.mark.parametrize("block", [4, 1 << 17])
def test_gaps_and_means_stay_inside_an_entity(frame, wanted, block):
    panel = made(frame, block_rows=block, partitions=7)
    got = {(r.entity or "", r.part, r.pos): (r.y, r.rolling_mean) for r in ops.panel_rolling_mean(panel, 3, ["y"]).collect()}
    means = wanted.groupby(["entity", "part"])["filled"].transform(lambda s: s.rolling(3, min_periods=1).mean())
    want = {k: v for k, v in zip(zip(wanted["entity"], wanted["part"], wanted["pos"]), zip(wanted["filled"], means)) if not pd.isna(v[0])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert not any(k[0] == "e5" for k in got)


def test_trend_of_each_entity(frame, wanted):
    got = {(r.entity or "", r.part): r for r in ops.panel_trend(made(frame), ["y"]).collect()}
    groups = {k: g["filled"].to_numpy() for k, g in wanted.groupby(["entity", "part"]) if len(g) >= 4 and g["y"].notna().any()}
    assert got.keys() == groups.keys()
    for k, y in groups.items():
        slope, intercept = np.polyfit(np.arange(len(y)), y, 1)
        assert (got[k].slope, got[k].intercept) == pytest.approx((slope, intercept), abs=1e-9)
        assert (got[k].n, got[k].start, got[k].end) == (len(y), y[0], y[-1]) and 0 <= got[k].p_value <= 1
    assert got["e6", 0].direction == "stable" and got["e6", 0].r2 == 0


@pytest.mark.parametrize("block", [5, 1 << 17])
def test_acf_of_each_entity(frame, wanted, block):
    got = {(r.entity or "", r.part, r.lag): r.acf for r in ops.panel_acf(made(frame, block_rows=block), ["y"], max_lags=6).collect()}
    want = {}
    for k, g in wanted.groupby(["entity", "part"]):
        y = g["filled"].to_numpy()
        if len(y) >= 15 and not np.isnan(y).any():
            e = y - y.mean()
            for lag in range(min(6, len(y) // 2 - 1) + 1):
                want[(*k, lag)] = None if np.ptp(y) == 0 else float(e[lag:] @ e[: len(e) - lag] / (e @ e))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_empty_panel(frame):
    panel = made(frame.limit(0))
    assert panel.table.count() == 0 and ops.panel_trend(panel, ["y"]).count() == 0 and ops.panel_acf(panel, ["y"]).count() == 0 and ops.panel_rolling_mean(panel, 3, ["y"]).count() == 0
