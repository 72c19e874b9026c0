"""Causal screens as expressions against their plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.functions import expressions
from geoweave.operators import causal


def test_tail_of_f(spark):
    rows = [(f, a, b) for f in (0.0, 1e-6, 0.1, 0.9, 3.0, 25.0, 400.0) for a in (1, 2, 3) for b in (1, 5, 18, 80, 500)]
    got = spark.createDataFrame(rows, "f double, a int, b int").select("*", expressions.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == pytest.approx(causal.f_tail(r.f, r.a, r.b), rel=1e-9) for r in got)


def series(seed=0):
    rng, out = np.random.default_rng(seed), []
    for z, n in enumerate((14, 20, 24, 40, 90, 10, 16)):
        x = rng.normal(size=n) if z % 2 else np.cumsum(rng.normal(size=n))
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = 0.5 * y[t - 1] + 0.6 * x[t - 1] + 0.3 * rng.normal()
        out.append((np.full(n, 2.0) if z == 6 else x, y))
    return out


def test_unit_roots_and_granger_equal_the_plain_forms(spark):
    held = series()
    df = spark.createDataFrame([(z, t, float(y[t]), float(x[t])) for z, (x, y) in enumerate(held) for t in range(len(x))] + [(0, 99, None, 1.0), (1, 99, 1.0, float("nan"))], "zone int, t int, y double, d double")
    arrays = spark.createDataFrame([(z, [float(v) for v in x]) for z, (x, _) in enumerate(held)], "zone int, v array<double>")
    for r in arrays.select("zone", causal.adf_of(F.col("v")).alias("a"), causal.stationary_of(F.col("v")).alias("s")).collect():
        x = held[r.zone][0]
        assert r.s == causal.is_stationary(x)
        if x.std() > 0:
            assert r.a.stat == pytest.approx(causal.adf_statistic(x), rel=1e-6)
    got = {r.zone: r for r in causal.granger_full(df, "y", ["d"], ["zone"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 6}  # ten values are too few
    for z, r in got.items():
        want = causal.granger(held[z][1], held[z][0])
        assert (r.n, r.best_lag, r.differenced) == (want["n"], want["best_lag"], want["differenced"]) or z == 6
        if z == 6:  # a constant explains nothing and has no test
            assert r.p_value is None
        else:
            assert r.p_value == pytest.approx(want["p_value"], rel=1e-6) and r.f_stat == pytest.approx(want["f_stat"], rel=1e-6)


def test_libraries_share_one_pass_and_converge(spark):
    rows = causal.coupled_logistic(240, skip=180)
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, t int, x double, y double")
    got = {r.size: (r.rho, r.n_boot) for r in causal.ccm_libraries(df, "x", "y", ["k"], 6).collect()}
    n = len(rows) - 2
    assert set(got) == {5, n // 4, n // 2, 3 * n // 4, n} and got[n][1] == 1 and got[5][1] == 6
    assert got[n][0] == pytest.approx(causal.cross_map(np.array([r[2] for r in rows]), np.array([r[1] for r in rows])), abs=1e-9)
    assert got[n][0] > got[5][0] + 0.1
    few = causal.ccm_libraries(df.where("t < 7"), "x", "y", ["k"], 2).collect()
    assert {r.size for r in few} == {5}


def test_the_regional_run_finds_the_planted_link(spark):
    rng, rows = np.random.default_rng(4), []
    for z in range(2):
        x, y, other = np.zeros(60), np.zeros(60), rng.normal(size=60)
        x[0], y[0] = 0.4, 0.2 + 0.1 * z
        for t in range(1, 60):
            x[t] = x[t - 1] * (3.8 - 3.8 * x[t - 1])
            y[t] = y[t - 1] * (3.5 - 3.5 * y[t - 1] - 0.35 * x[t - 1])
        rows += [(z, t, float(y[t]), float(x[t]), float(other[t])) for t in range(60)]
    df = spark.createDataFrame(rows, "zone int, t int, ndvi double, driver double, noise double")
    got = {(r.zone, r.driver): r for r in causal.regional_links(df, "ndvi", ["driver", "noise"], ["zone"], boots=5, surrogates=50).collect()}
    assert len(got) == 4
    for z in range(2):
        assert got[z, "driver"].link and got[z, "driver"].surrogate_p < 0.1 and not got[z, "noise"].link
        assert got[z, "driver"].q_value >= got[z, "driver"].p_value
