import datetime as dt

import numpy as np
import pytest

from terradrift.operators import classify as C
from terradrift.operators import mixture as M
from terradrift.operators import series
from terradrift import tables
from terradrift.operators.kernels import decimal_years, features, kernel_features, wide_features
from terradrift.schema import FEATURES

START = dt.date(2019, 1, 5)
DAYS = np.array([(START - dt.date(1970, 1, 1)).days + 6 * i for i in range(243)])
TAU = decimal_years(DAYS)
S = TAU - TAU[0]
SIGN = np.where(np.arange(243) % 2 == 0, 1.0, -1.0)
SERIES = {
    "flat": 0 * S,
    "flat_noisy": 5 * SIGN,
    "line": 10 * S,
    "accel_pos": 2.4 * S**2 - 4.2 * S,
    "accel_neg": -(2.4 * S**2 - 4.2 * S),
    "decel_pos": 15 * S - 2.4 * S**2,
    "decel_neg": -(15 * S - 2.4 * S**2),
    "annual": 6 * np.sin(2 * np.pi * TAU),
    "step": np.where(np.arange(243) < 121, 0.0, 12.0),
    "residual": 3 * S + 8 * SIGN,
}


def long_rows(spark, values=SERIES):
    rows = [("f", name, START + dt.timedelta(6 * i), None if np.isnan(v) else float(v)) for name, y in values.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "source_file string, pid string, acq_date date, disp double")


@pytest.fixture(scope="module")
def kernel(spark):
    return {r["pid"]: r for r in kernel_features(series.to_arrays(long_rows(spark))).collect()}


@pytest.mark.parametrize(
    "name, expected",
    [
        ("flat", dict(v_robust=0, rmse_detrended=0, seasonal_r2=1, velocity_r2=1)),
        ("flat_noisy", dict(rmse_detrended=5.0, n_jumps=0)),
        ("line", dict(v_robust=10, velocity_r2=1)),
        ("accel_pos", dict(v_robust=5.341, v_diff=9.579, quad_coeff=2.4, quad_r2=0.177, velocity_r2=0.823, cusum_score=6.708)),
        ("decel_neg", dict(v_robust=-5.459, v_diff=9.579, quad_r2=0.170, velocity_r2=0.830)),
        ("annual", dict(seasonal_amp=6.0, seasonal_r2=0.960, v_robust=-0.721, rmse_detrended=4.165, cusum_score=2.566)),
        ("step", dict(n_jumps=1, jump_max_mm=11.616, v_robust=4.51, velocity_r2=0.75, seasonal_r2=0.143)),
        ("residual", dict(v_robust=3.0, velocity_r2=0.157, rmse_deseason=8.0)),
    ],
)
def test_analytic_features(kernel, name, expected):
    for feature, value in expected.items():
        assert abs(kernel[name][feature] - value) < 0.006, feature


def test_classes_and_flags(spark, kernel):
    rows = kernel_features(series.to_arrays(long_rows(spark))).select("pid", C.rule_class().alias("rule"), *[e.alias(k) for k, e in C.flags().items()]).collect()
    got = {r["pid"]: r for r in rows}
    assert {k: r["rule"] for k, r in got.items()} == dict(flat="stable", flat_noisy="noisy", line="linear", accel_pos="accel", accel_neg="accel", decel_pos="decel", decel_neg="decel", annual="noisy", step="linear", residual=None)
    assert got["annual"]["periodic"] and got["flat"]["periodic"] and not got["step"]["periodic"]
    assert got["step"]["jumpy"] and got["accel_pos"]["variable_flag"] and got["residual"]["noisy_trend"]


def test_gates_and_missing_values():
    y = np.full((5, 243), np.nan)
    y[0, :9] = y[1, :10] = np.arange(10)[:9].mean()
    y[1, :10] = np.arange(10)
    y[2, :120:2], y[2, 200:204] = 1.0, 2.0
    y[4] = 10 * S
    y[4, ::7] = np.inf
    f = dict(zip(FEATURES, features(y, DAYS).T, strict=True))
    assert f["v_robust"][0] == 0 and np.isnan(f["rmse_detrended"][0]) and not np.isnan(f["rmse_detrended"][1])
    assert np.isnan(f["v_second_half"][2]) and np.isnan(f["velocity_r2"][3]) and f["n_valid_frac"][3] == 0
    assert abs(f["v_robust"][4] - 10) < 1e-9
    assert np.isnan(features(y[:1], DAYS)[0, :12]).all()


def test_sql_path_equals_kernel(spark, kernel):
    rng = np.random.default_rng(1)
    gaps = {f"g{k}": np.where(rng.random(243) < 0.3 * k, np.nan, 3 * S + rng.normal(0, 2, 243)) for k in range(4)}
    values = gaps | {k: v for k, v in SERIES.items() if k not in ("flat", "line")}
    long = long_rows(spark, values)
    sql = {r["pid"]: r for r in series.sql_features(series.on_axis(long)).collect()}
    arr = {r["pid"]: r for r in kernel_features(series.to_arrays(long)).collect()}
    for pid, row in sql.items():
        for name in set(row.asDict()) - {"source_file", "pid", "n_valid"}:
            a, b = row[name], arr[pid][name]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6 * max(1, abs(b))), (pid, name)


def test_few_dates_give_no_rows(spark):
    long = long_rows(spark, {"x": np.arange(19.0)})
    assert kernel_features(series.to_arrays(long)).count() == 0


def test_wide_rows_need_no_shuffle(spark):
    """The kernel on a wide table gives what it gives on arrays made of long rows, in the scan's own stage."""
    rng = np.random.default_rng(4)
    values = {f"p{k}": np.where(rng.random(30) < 0.1, np.nan, rng.normal(0, 3, 30).cumsum()) for k in range(25)} | {"short": np.full(30, np.nan)}
    long = long_rows(spark, values)
    dates = sorted({r[0].strftime("%Y%m%d") for r in long.select("acq_date").distinct().collect()})
    wide = series.to_wide(long, dates)
    rows = [tuple(r) for r in wide.select("source_file", "pid", *dates).collect()]
    wide = spark.createDataFrame(rows, "source_file string, pid string, " + ", ".join(f"`{d}` float" for d in dates))
    got = {r["pid"]: r for r in wide_features(wide).collect()}
    want = {r["pid"]: r for r in kernel_features(series.to_arrays(series.to_long(wide))).collect()}
    assert got.keys() == want.keys() == values.keys()
    for p, row in got.items():
        for name, a in row.asDict().items():
            b = want[p][name]
            assert a == b or isinstance(a, float) and abs(a - b) < 1e-9 * max(1, abs(b)), (p, name)
    assert "Exchange" not in wide_features(wide)._jdf.queryExecution().executedPlan().toString()
    assert wide_features(wide.select("source_file", "pid", *dates[:19])).count() == 0


def test_arrays_of_differing_dates_in_one_batch(spark):
    a = long_rows(spark, {"a": np.arange(30.0), "b": np.arange(30.0) ** 1.5})
    b = long_rows(spark, {"c": np.arange(25.0) * 2})
    arrays = series.to_arrays(a).unionByName(series.to_arrays(b)).coalesce(1)
    got = {r["pid"]: (r["n_valid"], round(r["velocity_r2"], 3)) for r in kernel_features(arrays).collect()}
    assert got["a"] == (30, 1.0) and got["c"] == (25, 1.0) and got["b"][0] == 30


def test_quantiles_are_exact(spark, monkeypatch):
    """Against NumPy, with ties, nulls, groups of one row, and a coarse sketch."""
    monkeypatch.setattr(tables, "ACCURACY", 40)
    rng = np.random.default_rng(6)
    rows = [("a", float(v), float(rng.integers(0, 3))) for v in rng.normal(0, 5, 5000)] + [("b", float(v), None) for v in range(7)] + [("c", 1.5, 2.5)] + [("a", None, None)] * 20
    df = spark.createDataFrame(rows, "source_file string, u double, w double").repartition(5)
    got = {r["source_file"]: r for r in tables.quantiles(tables.Stage(spark, "q"), df, ["source_file"], ["u", "w"], (0.25, 0.5, 0.9)).collect()}
    for f in "abc":
        for k, c in enumerate("uw"):
            v = [r[k + 1] for r in rows if r[0] == f and r[k + 1] is not None]
            assert not v and not got[f][c] or np.allclose(got[f][c], np.quantile(v, [0.25, 0.5, 0.9]), rtol=1e-12), (f, c)
    whole = tables.quantiles(tables.Stage(spark, "q"), df, [], ["u"], (0.5,)).collect()
    assert np.allclose(whole[0]["u"], [np.median([r[1] for r in rows if r[1] is not None])])


def test_mixture_over_all_rows_of_a_large_file(spark):
    """Distributed passes end where passes over all rows in one place end, and the starts' sample doesn't decide."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((-6, 0.5, 900), (0, 1.0, 600), (5, 0.7, 60))])
    rows = [("big", str(i), float(v[0]), float(v[1])) for i, v in enumerate(x)] + [("small", str(i), float(v[0]), float(v[1])) for i, v in enumerate(x[::20])]
    df = spark.createDataFrame(rows, "source_file string, pid string, u double, w double").repartition(6)
    got = {r["source_file"]: r for r in M.fitted(df, ["u", "w"], 3, local_rows=300).collect()}
    assert got["big"]["done"] and got["small"]["done"]
    w, m, c = np.array(got["big"]["weights"]), np.array(got["big"]["means"]).reshape(-1, 2), np.array(got["big"]["covs"]).reshape(-1, 2, 2)
    score = M.responsibilities(x, w, m, c)[1]
    assert abs(score - got["big"]["score"]) < 1e-9
    best = M.fit(x, 3)
    assert score > M.responsibilities(x, *best[:3])[1] - 0.01
    order, ours = np.argsort(best[1][:, 0]), np.argsort(m[:, 0])
    assert np.allclose(best[1][order], m[ours], atol=0.05) and abs(w[ours][2] - 60 / 1560) < 0.005  # the small component is whole
    labels = M.classify_residual(df, ["u", "w"], 3, local_rows=300).where("source_file = 'big'").groupBy("class_1").count().collect()
    assert sorted(r["count"] for r in labels)[0] > 50


def test_sums_of_parts_give_the_whole_step():
    rng = np.random.default_rng(2)
    x, means = rng.normal(0, 2, (500, 3)), rng.normal(0, 1, (4, 3))
    r = rng.dirichlet(np.ones(4), 500)
    whole = M.maximised(*M.sums(x, r, means), means, "full", 1e-3)
    parts = [M.sums(x[i::7], r[i::7], means) for i in range(7)]
    again = M.maximised(*(sum(p) for p in zip(*parts, strict=True)), means, "full", 1e-3)
    assert all(np.allclose(a, b) for a, b in zip(whole, again, strict=True))
    assert np.allclose(whole[1], (r.T @ x) / r.sum(0)[:, None])


def test_mixture_properties(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in (-4, 0, 4)])
    best, weights, means, covs, history = M._fit_once(x, 3, "full", 1e-3, np.random.default_rng(3))
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:], strict=False))
    p, _ = M.responsibilities(x, *M.fit(x, 3)[:3])
    assert np.allclose(p.sum(1), 1) and len(set(p.argmax(1)[:80])) == 1 and len(set(p.argmax(1))) == 3
    assert [M.components(n, 5, 18) for n in (25, 200, 450, 10_000)] == [2, 2, 5, 5]
    rows = [("a", str(i), float(v[0]), float(v[1])) for i, v in enumerate(x)] + [("a", "hole", None, 1.0), ("b", "small", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source_file string, pid string, u double, w double")
    got = {(r["source_file"], r["pid"]): r for r in M.classify_residual(df, ["u", "w"]).collect()}
    assert (got["a", "hole"]["class_1"], got["a", "hole"]["class_prob_1"]) == ("other", 0.0)
    assert (got["b", "small"]["class_1"], got["b", "small"]["class_prob_1"]) == ("other", 1.0)
    assert len(got) == len(rows)
