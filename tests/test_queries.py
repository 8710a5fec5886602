"""Every registered query of the point model against its SQL, on the smallest tables."""

import datetime as dt
import math
import os

import pytest

from terradrift.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return float(x)
    if isinstance(x, list | tuple):
        return str([plain(v) for v in x])
    return x.isoformat() if isinstance(x, dt.date) else str(x)


def ordered(rows):
    return sorted([tuple(plain(v) for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    result = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered([row[i] for i in at] for row in result.fetchall())


def test_others_are_these():
    """Each of them has a test of its values below or in the tests of its operator."""
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"kernel_features_of_users", "mixture_classes", "full_classification", "cluster_polygons", "cluster_geojson"}


def test_kernel_features_of_users(spark, duck):
    """Seasonal and jump features too, series by series, by plain least squares."""
    import numpy as np

    rows = duck.execute("select cast(user_id as varchar), cast(ts as date), sum(value) from events group by 1, 2").fetchall()
    days = sorted({d for _, d, _ in rows})
    tau = np.array([d.year + (d - dt.date(d.year, 1, 1)).days / (dt.date(d.year + 1, 1, 1) - dt.date(d.year, 1, 1)).days for d in days])
    t = tau - tau.mean()
    wave = np.column_stack([np.ones(len(t)), t, *(f(2 * k * np.pi * tau) for k in (1, 2) for f in (np.cos, np.sin))])
    values = {p: np.full(len(days), np.nan) for p, _, _ in rows}
    for p, d, v in rows:
        values[p][days.index(d)] = v
    got = {r["pid"]: r for r in plans.kernel_features_of_users(spark, DATA).collect()} if len(days) >= 20 else {}
    assert set(got) == set(values) and len(got) > 5
    checked = 0
    for p, y in values.items():
        m = ~np.isnan(y)
        assert got[p]["n_valid"] == m.sum()
        if m.sum() < 10:
            assert got[p]["seasonal_r2"] is None
            continue
        c1 = np.linalg.lstsq(wave[m, :2], y[m], rcond=None)[0]
        c6 = np.linalg.lstsq(wave[m], y[m], rcond=None)[0]
        r1, r6 = y[m] - wave[m, :2] @ c1, y[m] - wave[m] @ c6
        if np.linalg.cond(wave[m].T @ wave[m]) < 1e9:
            assert math.isclose(got[p]["rmse_deseason"], math.sqrt((r6**2).mean()), rel_tol=1e-4)
            assert abs(got[p]["seasonal_r2"] - max(-1, min(1, 1 - (r6**2).sum() / max((r1**2).sum(), 1e-9)))) < 1e-4
            checked += 1
        assert got[p]["n_jumps"] >= 0 and (got[p]["n_jumps"] == 0) == (got[p]["jump_max_mm"] == 0)
    print(checked)


def test_classes_of_all_rows(spark, duck):
    from terradrift import schema

    vectors = {r[0] for r in duck.execute("select cast(vec_id as varchar) from embeddings").fetchall()}
    got = plans.mixture_classes(spark, DATA).collect()
    assert {r["pid"] for r in got} == vectors and len(got) == len(vectors)
    assert all(r["class_1"] in schema.CLASSES and r["class_1"] != r["class_2"] and 0.2 <= r["class_prob_1"] <= 1 + 1e-6 for r in got)
    full = {r["pid"]: r for r in plans.full_classification(spark, DATA).collect()}
    suppliers = {r[0] for r in duck.execute("select distinct cast(l_suppkey as varchar) from lineitem").fetchall()}
    assert set(full) == suppliers | {"none"} and full["none"]["class_1"] == schema.UNCLASSIFIED
    assert all(full[p]["class_1"] in schema.CLASSES for p in suppliers)


def test_polygons_of_clusters(spark, duck):
    """Areas by the formula of a convex set's neighbourhood, from hulls made another way; the features name the same clusters."""
    import numpy as np

    larger = DATA.replace("sf0.001", "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("too few points for clusters")
    customers = f"(select * from read_parquet('{larger}/customer.parquet'))"
    rows = duck.execute(f"with recursive {plans._dbscan_sql(plans._CUST.replace('from customer', 'from ' + customers))} select label, e, n from lab where label >= 0").fetchall()
    groups = {}
    for label, e, n in rows:
        groups.setdefault(label, set()).add((e, n))
    got = {r["label"]: r for r in plans.cluster_polygons(spark, larger).collect()}
    assert set(got) == set(groups) and len(got) > 0
    for label, points in groups.items():
        p = np.array(sorted(points))
        # an edge of the hull has all points on one side
        edges = [(a, b) for a in p for b in p if (a != b).any() and ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-9).all()]
        longest = {}
        for a, b in edges:  # of collinear ones the whole
            key = tuple(np.round((b - a) / np.hypot(*(b - a)), 9))
            if key not in longest or np.hypot(*(b - a)) > np.hypot(*(longest[key][1] - longest[key][0])):
                longest[key] = (a, b)
        around = sum(np.hypot(*(b - a)) for a, b in longest.values())
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in longest.values())) / 2
        radius = 20 + (1 if len(points) < 3 and sum(r[0] == label for r in rows) < 3 else 0)
        assert abs(got[label]["area_m2"] - (area + around * radius + np.pi * radius**2)) < 0.002 * got[label]["area_m2"] + 3, label
        assert got[label]["area_ha"] == pytest.approx(got[label]["area_m2"] / 1e4, abs=1e-4)
    import json

    features = [json.loads(r["feature"]) for r in plans.cluster_geojson(spark, larger).collect()]
    assert {f["properties"]["cluster_id"] for f in features} == {f"CL_{k:04d}" for k in groups}
    for f in features:
        xy = np.array(f["geometry"]["coordinates"][0])
        assert (xy[0] == xy[-1]).all() and f["bbox"] == [*xy.min(0), *xy.max(0)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
