"""Gaussian mixture for the points that no rule takes, fitted per file on all its complete rows.

A file of LOCAL_ROWS complete rows at most is fitted in one task. A larger one gets its start values from a fit of
so many rows of least hash; from there expectation and maximisation run over all its rows: tasks sum the
responsibilities, weighted rows and weighted squares of their rows, the sums meet by file, and the file's parameters
are made from them, until its mean log-likelihood rises by less than TOLERANCE. No file is gathered in one task.

Rows that no rule takes have no rule label that could seed a component, so all starts are rows drawn at random, the best of
RESTARTS being kept. Components are ordered by their weight and named after the classes by position."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift.schema import CLASSES
from terradrift.ship import ship
from terradrift.tables import Stage

LOCAL_ROWS = 50_000
#: Numbers of all files' parameters that may be broadcast; beyond it rows and parameters are joined by file.
BROADCAST_NUMBERS = 4_000_000
# Fixed values of the fit, and the ridges that are tried in turn.
RESTARTS, TOLERANCE, STEPS, SEED = 5, 1e-4, 300, 42
RIDGES = (1e-3, 1e-2, 1e-1, 0.5)


def components(n: int, wanted: int, width: int) -> int:
    """Components that n complete rows support."""
    return min(wanted, max(2, n // max(5 * width, 20)))


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * ((z * z).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
    return out


def responsibilities(x: np.ndarray, weights, means, covs) -> tuple[np.ndarray, float]:
    joint = log_density(x, means, covs) + np.log(weights)
    top = joint.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
    return np.exp(joint - total[:, None]), float(total.mean())


def _shaped(cov: np.ndarray, kind: str, ridge: float) -> np.ndarray:
    d = len(cov)
    if kind == "diag":
        cov = np.diag(np.diag(cov))
    elif kind == "spherical":
        cov = np.eye(d) * np.trace(cov) / d
    return cov + ridge * np.eye(d)


def _fit_once(x, k, kind, ridge, rng):
    means = x[rng.choice(len(x), k, replace=False)]
    covs = np.stack([_shaped(np.cov(x.T).reshape(x.shape[1], -1), kind, ridge)] * k)
    weights, before, history = np.full(k, 1 / k), -np.inf, []
    for _ in range(STEPS):
        r, score = responsibilities(x, weights, means, covs)
        history.append(score)
        if score - before < TOLERANCE:
            break
        before = score
        weights, means, covs = maximised(*sums(x, r, means), means, kind, ridge)
    return before, weights, means, covs, history


def sums(x: np.ndarray, r: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each component: the responsibilities, and the weighted first and second moments about its mean."""
    moved = [x - m for m in means]
    return r.sum(0), np.stack([r[:, i] @ y for i, y in enumerate(moved)]), np.stack([(r[:, i, None] * y).T @ y for i, y in enumerate(moved)])


def maximised(n: np.ndarray, first: np.ndarray, second: np.ndarray, means: np.ndarray, kind: str, ridge: float):
    """Weights, means and covariances from sums(), which may be those of many parts."""
    n = n + 1e-10
    shift = first / n[:, None]
    covs = second / n[:, None, None] - shift[:, :, None] * shift[:, None, :]
    return n / n.sum(), means + shift, np.stack([_shaped(c, kind, ridge) for c in covs])


def fit(x: np.ndarray, k: int, seed: int = SEED):
    """weights, means, covariances, shape and ridge of the best of several starts; simpler shapes and wider ridges
    where one fails."""
    for kind in ("full", "diag", "spherical"):
        for ridge in RIDGES:
            rng = np.random.default_rng(seed)
            try:
                best = max((_fit_once(x, k, kind, ridge, rng) for _ in range(RESTARTS)), key=lambda f: f[0])
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(best[0]):
                order = np.argsort(-best[1], kind="stable")
                return best[1][order], best[2][order], best[3][order], kind, ridge
    raise np.linalg.LinAlgError("no shape fits")


def classes_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second class and the first's probability; components of one class add up."""
    names = np.arange(p.shape[1]) % len(CLASSES)
    total = np.zeros((len(p), len(CLASSES)))
    np.add.at(total.T, names, p.T)
    total /= total.sum(1, keepdims=True)
    order = np.argsort(-total, 1, kind="stable")
    label = np.array(CLASSES)
    return label[order[:, 0]], label[order[:, 1]], np.take_along_axis(total, order[:, :1], 1)[:, 0]


_MODEL = "source_file string, weights array<double>, means array<double>, covs array<double>, kind string, ridge double, score double, done boolean"


def _with_models(rows: DataFrame, models: DataFrame, how: str) -> DataFrame:
    """rows joined with their file's parameters, which are counted first."""
    numbers = models.agg(F.sum(F.size("weights") + F.size("means") + F.size("covs"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        models = F.broadcast(models)
    return rows.join(models, "source_file", how)


def _model(pdf, weights, means, covs, kind, ridge, score, done):
    import pandas as pd

    return pd.DataFrame({"source_file": [pdf["source_file"].iloc[0]], "weights": [weights.tolist()], "means": [means.ravel().tolist()], "covs": [covs.ravel().tolist()], "kind": [kind], "ridge": [ridge], "score": [score], "done": [done]})


def _unpacked(row, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(row.weights), np.asarray(row.means).reshape(-1, d), np.asarray(row.covs).reshape(-1, d, d)


def _pass(stage: Stage, rows: DataFrame, models: DataFrame, features: list[str], name: str) -> DataFrame:
    """Parameters after one pass over all rows of the files that aren't done."""
    d = len(features)

    def add(batches):
        import pandas as pd

        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for file, part in pdf.groupby("source_file"):
                weights, means, covs = _unpacked(part.iloc[0], d)
                x = part[features].to_numpy(float)
                r, score = responsibilities(x, weights, means, covs)
                mine = np.concatenate([v.ravel() for v in (*sums(x, r, means), np.array([score * len(x), len(x)]))])
                held[file] = held.get(file, 0) + mine
        for file, total in held.items():
            yield pd.DataFrame({"source_file": file, "at": np.arange(len(total), dtype=np.int32), "value": total})

    def step(pdf):
        old = pdf.iloc[0]  # a row a file
        weights, means, covs = _unpacked(old, d)
        total, k = np.array([e["value"] for e in old["totals"]]), len(weights)
        n, first, second = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d : -2].reshape(k, d, d)
        score = float(total[-2] / total[-1])
        done = bool(score - old["score"] < TOLERANCE)  # these parameters' likelihood against the last ones'
        new = (weights, means, covs) if done else maximised(n, first, second, means, old["kind"], old["ridge"])
        try:
            np.linalg.cholesky(new[2])
        except np.linalg.LinAlgError:
            new, done = (weights, means, covs), True
        return _model(pdf, *new, old["kind"], old["ridge"], score, done)

    open_ = models.where("not done")
    totals = _with_models(rows, open_.select("source_file", "weights", "means", "covs"), "inner").mapInPandas(add, "source_file string, at int, value double")
    totals = totals.groupBy("source_file", "at").agg(F.sum("value").alias("value"))
    totals = totals.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("totals"))  # as many numbers as parameters
    new = totals.join(open_, "source_file").groupBy("source_file").applyInPandas(step, _MODEL)
    return stage.keep(new.unionByName(models.where("done")), name)


def fitted(rows: DataFrame, features: list[str], wanted: int = 5, local_rows: int = LOCAL_ROWS, seed: int = SEED) -> DataFrame:
    """source_file, weights, means and covs (flattened), kind, ridge, score (mean log-likelihood) and done of the files with 5 * wanted
    complete rows or more. rows: complete ones."""
    ship(rows.sparkSession)
    stage, d = Stage(rows.sparkSession, "mixture"), len(features)
    rows = stage.keep(rows.select("source_file", "pid", *features), "rows")
    sizes = stage.keep(rows.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") >= 5 * wanted), "sizes")
    rows = rows.join(sizes, "source_file")
    # of a larger file, twice the rows wanted by hash and then the least of them
    share = F.pmod(F.xxhash64("pid"), F.lit(1 << 40)) < F.lit(2.0 * local_rows) / F.col("n") * F.lit(float(1 << 40))
    by = Window.partitionBy("source_file").orderBy(F.xxhash64("pid"), "pid")
    start = rows.where((F.col("n") <= local_rows) | share).withColumn("r", F.row_number().over(by)).where(F.col("r") <= local_rows)

    def local(pdf):
        x, n = pdf[features].to_numpy(float), int(pdf["n"].iloc[0])
        weights, means, covs, kind, ridge = fit(x, components(n, wanted, d), seed)
        return _model(pdf, weights, means, covs, kind, ridge, responsibilities(x, weights, means, covs)[1] if n <= local_rows else -np.inf, n <= local_rows)

    models = stage.keep(start.select("source_file", "n", *features).groupBy("source_file").applyInPandas(local, _MODEL), "models-0")
    for k in range(1, STEPS + 1):
        if models.where("not done").isEmpty():
            break
        models = _pass(stage, rows, models, features, f"models-{k}")
    return models


def classify_residual(rows: DataFrame, features: list[str], wanted: int = 5, local_rows: int = LOCAL_ROWS, seed: int = SEED) -> DataFrame:
    """source_file, pid, class_1, class_2, class_prob_1 of scaled residual rows. Files with fewer than 5 * wanted
    complete rows stay `other` with probability 1; incomplete rows elsewhere are `other` with 0."""
    complete, d = " and ".join(f"`{f}` is not null" for f in features), len(features)
    models = fitted(rows.where(complete), features, wanted, local_rows, seed)
    joined = _with_models(rows.select("source_file", "pid", *features), models.select("source_file", "weights", "means", "covs"), "left")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            first, second, prob = np.full(len(pdf), "other", object), np.full(len(pdf), "other", object), np.ones(len(pdf))
            has = pdf["weights"].notna().to_numpy()
            x = pdf[features].to_numpy(float)
            prob[has & np.isnan(x).any(1)] = 0.0
            use = has & ~np.isnan(x).any(1)
            for file in pdf["source_file"][use].unique():
                at = np.flatnonzero(use & (pdf["source_file"] == file).to_numpy())
                weights, means, covs = _unpacked(pdf.iloc[at[0]], d)
                order = np.argsort(-weights, kind="stable")
                p, _ = responsibilities(x[at], weights[order], means[order], covs[order])
                first[at], second[at], prob[at] = classes_of(p)
            yield pd.DataFrame({"source_file": pdf["source_file"], "pid": pdf["pid"], "class_1": first, "class_2": second, "class_prob_1": prob.astype(np.float32)})

    return joined.mapInPandas(run, "source_file string, pid string, class_1 string, class_2 string, class_prob_1 float")
