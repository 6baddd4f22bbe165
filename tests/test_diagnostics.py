"""Residual diagnostics against plain loops, across block borders."""

import math

import numpy as np
import pytest

from sondeo.functions.tails import gamma_upper
from sondeo.operators.diagnostics import residual_diagnostics


def framed(spark, **series):
    rows = [(name, i, None if v is None else float(v)) for name, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, pos bigint, y double")


def test_gamma_tail():
    # both branches of the closed form for a whole number of pairs of degrees, and of the half
    for a in (1, 5, 12):
        for x in (1e-6, 0.5, a + 0.9, a + 1.1, 40.0):
            assert gamma_upper(a, x) == pytest.approx(math.exp(-x) * sum(x**i / math.factorial(i) for i in range(a)), rel=1e-10)
    for x in (1e-6, 0.7, 1.6, 30.0):
        assert gamma_upper(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-10)
    assert gamma_upper(3.0, 0.0) == 1.0


@pytest.mark.parametrize("block_rows", [7, 1 << 17])
def test_equals_a_loop(spark, block_rows):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=60)
    walk = np.cumsum(rng.normal(size=45)) + 2
    found = {r["series"]: r for r in residual_diagnostics(framed(spark, noise=noise, walk=[None, *walk]), 5, 1, block_rows).collect()}
    for name, e in (("noise", noise), ("walk", walk)):
        r, n, d = found[name], len(e), e - e.mean()
        q = n * (n + 2) * sum((d[k:] @ d[:-k] / (d @ d)) ** 2 / (n - k) for k in range(1, 6))
        up = int((e >= 0).sum())
        runs = 1 + int(((e[1:] >= 0) != (e[:-1] >= 0)).sum())
        m = 2 * up * (n - up) / n
        assert (r["n"], r["runs"]) == (n, runs) and r["bias"] == pytest.approx(e.mean())
        assert r["ljung_box"] == pytest.approx(q) and r["ljung_box_p"] == pytest.approx(math.exp(-q / 2) * (1 + q / 2))
        assert r["runs_z"] == pytest.approx((runs - m - 1) / math.sqrt(m * (m - 1) / (n - 1)))
    assert found["noise"]["white_noise"] and not found["walk"]["white_noise"]


def test_constant_short_and_empty(spark):
    found = {r["series"]: r for r in residual_diagnostics(framed(spark, flat=[2.0] * 30, short=[1.0, -1.0, 1.0], one=[0.0], gone=[None, None]), 5).collect()}
    assert set(found) == {"flat", "short", "one"}
    assert (found["flat"]["ljung_box"], found["flat"]["runs"], found["flat"]["runs_p"], found["flat"]["bias"]) == (None, 1, None, 2.0)
    assert (found["flat"]["bias_p"], found["flat"]["white_noise"]) == (0.0, False)
    assert (found["short"]["ljung_box"], found["short"]["runs"]) == (None, 3)
    assert (found["one"]["n"], found["one"]["bias_p"], found["one"]["runs_z"]) == (1, None, None)
    assert residual_diagnostics(framed(spark, none=[]), 5).count() == 0
    with pytest.raises(ValueError, match="lags"):
        residual_diagnostics(framed(spark, none=[]), 2, 2)
