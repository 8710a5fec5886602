import numpy as np
import pytest

from terradrift.operators import clusters
from terradrift.operators import dbscan as D
from terradrift.operators.dbscan import dbscan


def sequential(x, eps, least):
    """Seed and grow, one point after another."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, label, n = d.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            for j in np.flatnonzero(d[todo.pop()]):
                if label[j] < 0:
                    label[j] = n
                    if core[j]:
                        todo.append(j)
        n += 1
    return label


@pytest.mark.parametrize("seed, side, n", [(1, 900, 300), (2, 300, 300), (3, 4000, 200)])
def test_against_seed_and_grow(spark, seed, side, n):
    rng = np.random.default_rng(seed)
    p = np.column_stack([rng.integers(0, side, n), rng.integers(0, side, n), rng.normal(0, 2, n).round(2)]).astype(float)
    rows = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(p)], "idx long, e double, n double, v double")
    got = np.array([r["label"] for r in dbscan(rows, 100, 3, 5).orderBy("idx").collect()])
    assert (got == sequential(p * [1, 1, 100 / 3], 100, 5)).all()


def test_inclusive_chain_dense_cell_and_contested_border(spark):
    rows = [(i, 100.0 * i, 0.0, 0.0) for i in range(6)]  # a chain of exactly eps
    rows += [(100 + i, 10_000 + i % 3, 10_000 + i % 2, 0.0) for i in range(30)]  # one dense cell
    rows += [(200, 10_000.0, 10_101.0, 0.0)]
    df = spark.createDataFrame([(i, float(a), float(b), v) for i, a, b, v in rows], "idx long, e double, n double, v double")
    got = {r["idx"]: r["label"] for r in dbscan(df, 100, 3, 2).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[100 + i] for i in range(30)} == {1} and got[200] == 1
    assert set(r["label"] for r in dbscan(df, 100, 3, 50).collect()) == {-1}
    x = np.array([r[1:3] + (r[3] * 100 / 3,) for r in rows], float)
    got = np.array([r["label"] for r in dbscan(df, 100, 3, 5).orderBy("idx").collect()])
    assert (got == sequential(x, 100, 5)).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_places(spark, seed, monkeypatch):
    """Dense cells that only a few far corners join, shells just beyond reach, and copies of one place."""
    monkeypatch.setattr(D, "FEW_PAIRS", 9)
    monkeypatch.setattr(D, "MANY_OPEN", 0 if seed == 1 else 200_000)
    rng = np.random.default_rng(seed)
    blob = lambda x, y, n, w: np.column_stack([rng.uniform(x, x + w, n), rng.uniform(y, y + w, n), rng.normal(0, 0.2, n)])
    ring = lambda r, n: np.column_stack([r * np.cos(a := rng.uniform(0, 2 * np.pi, n)), r * np.sin(a), np.zeros(n)])
    p = [blob(0, 0, 200, 60), blob(150, 0, 200, 40), blob(240, 5, 150, 30), blob(3000, 3000, 250, 400)]
    p += [np.array([[9000.0, 9000.0, 0.0]] * 40), np.array([[9100.0, 9000.0, 0.0]] * 40), np.array([[9200.0, 9000.001, 0.0]] * 40)]
    p += [ring(20, 120) + [20000, 20000, 0], ring(130, 300) + [20000, 20000, 0], ring(235, 300) + [20000, 20000, 0]]
    p = np.concatenate(p).round(3)
    rows = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(p)], "idx long, e double, n double, v double")
    for least in (3, 5, 30):
        got = np.array([r["label"] for r in dbscan(rows, 100, 3, least).orderBy("idx").collect()])
        assert (got == sequential(p * [1, 1, 100 / 3], 100, least)).all(), least


def test_a_crowded_cell_costs_its_size(spark, monkeypatch):
    """Fifty thousand points in one place and some around it: no table of pairs grows with their square."""
    written = {}

    class Counted(D.Stage):
        def keep(self, df, name):
            out = super().keep(df, name)
            written[name] = out.count()
            return out

    monkeypatch.setattr(D, "Stage", Counted)
    df = spark.range(50_000).selectExpr("id as idx", "(id * 7919 % 9973) / 100.0D as e", "(id * 104729 % 9949) / 100.0D as n", "(id % 7) * 0.01D as v")
    df = df.unionByName(spark.range(60).selectExpr("id + 100000 as idx", "100.0D + id * 3 as e", "50.0D as n", "0.0D as v"))
    got = dbscan(df, 100, 3, 5)
    assert [(r["label"], r["count"]) for r in got.groupBy("label").count().collect()] == [(0, 50_060)]
    assert max(n for name, n in written.items() if name not in ("points", "core", "numbers", "lone")) < 20_000, written


def test_velocity_separates(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 3.0), (3, 0.0, 0.0, 6.1)], "idx long, e double, n double, v double")
    assert [r["label"] for r in dbscan(df, 100, 3, 2).orderBy("idx").collect()] == [0, 0, -1]


def test_groups_and_empty(spark):
    df = spark.createDataFrame([(i, 0.0, float(i), 0.0, "a" if i % 2 else "b") for i in range(10)], "idx long, e double, n double, v double, class_1 string")
    assert {(r["class_1"], r["label"]) for r in dbscan(df, 5, 3, 3, ("class_1",)).collect()} == {("a", 0), ("b", 0)}
    assert dbscan(df.limit(0), 5, 3, 3).collect() == []


def test_summary_ties_and_polygons(spark):
    rows = [(0, 0.0, 0.0, 1.0, 0.5, "b"), (0, 100.0, 0.0, 2.0, 0.7, "a"), (0, 0.0, 100.0, 3.0, 0.6, "c"), (1, 5.0, 5.0, 1.0, 0.5, "a"), (2, 0.0, 0.0, 1.0, 0.5, "a"), (2, 10.0, 0.0, 1.0, 0.5, "a"), (-1, 9.0, 9.0, 0.0, 0.0, "z")]
    m = spark.createDataFrame(rows, "label long, e double, n double, v double, coherence double, class_1 string")
    s = {r["cluster_id"]: r for r in clusters.summarise(m).collect()}
    assert set(s) == {"CL_0000", "CL_0001", "CL_0002"}
    assert (s["CL_0000"]["dom_class"], s["CL_0000"]["class_purity"], s["CL_0000"]["is_mixed"], s["CL_0000"]["vel_std"]) == ("a", 0.333, True, 0.82)
    a = {r["label"]: r["area_m2"] for r in clusters.polygons(m, ["label"], 20).collect()}
    assert abs(a[0] - (5000 + 20 * (200 + 20000**0.5) + np.pi * 400)) < 3
    assert abs(a[1] - np.pi * 441) < 2 and abs(a[2] - (10 * 42 + np.pi * 441)) < 2


def test_write_back(spark):
    p = spark.createDataFrame([("f", "1", "old"), ("f", "2", "old")], "source_file string, pid string, cluster_id string")
    a = spark.createDataFrame([("f", "1", "CL_0001"), ("f", "1", "CL_0001")], "source_file string, pid string, cluster_id string")
    assert sorted((r["pid"], r["cluster_id"]) for r in clusters.with_cluster_ids(p, a).collect()) == [("1", "CL_0001"), ("2", "NOISE")]
    b = a.withColumnRenamed("cluster_id", "subcluster_id")
    assert sorted((r["pid"], r["subcluster_id"]) for r in clusters.with_subcluster_ids(p, b).collect()) == [("1", "CL_0001"), ("2", None)]
