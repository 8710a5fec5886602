"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(theta_k - w . x): one weight vector shared by all ordered thresholds, with x_j =
1 + log(count) of a word j that occurs, words being runs of letters and digits, lower-cased. The cumulative links are
fitted together on a bounded sample of labelled rows (fit_rows, those with the least hash of doc_id) by
accelerated proximal gradient with an L1 penalty, which leaves few non-zero weights; every document is then
scored on its whole text. Features are 64-bit word hashes, never folded into buckets, so no rare word can share the
weight of a toxic one.

Labels say toxic or not; the severity grade of a toxic row is derived: 1, or 2 and 3 with at least
GRADE_HITS occurrences of words that mark toxic rows in the sample. A label table with a `severity`
column is used as it is.

Nulls: a null text has no words and gets the severity of the thresholds alone; null labels and ids don't
take part in the fit. Repeated rows are scored alike. Without labelled toxic rows every severity is 0.
Empty table: empty result. Only doc_id and text of documents are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import ALNUM, Words, blocks, hashed_share, utf8
from terradrift.ship import ship

#: Labelled rows that the fit takes at most.
FIT_ROWS = 10_000
#: Occurrences of marking words from which a toxic row is of grade 2 and 3.
GRADE_HITS = (3, 6)
L1, RIDGE, STEPS = 0.022, 1e-4, 400


@dataclass
class OrdinalModel:
    hashes: np.ndarray  # sorted uint64 hashes of words with a weight
    weights: np.ndarray
    thetas: np.ndarray

    def at_least(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - f[:, None], -50, 50)))


def _counts(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct words; keep: sorted hashes that matter."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    h = words.hash
    if keep is not None:
        at = np.searchsorted(keep, h)
        at[at == len(keep)] = 0
        ok = keep[at] == h if len(keep) else np.zeros(len(h), bool)
        doc, h = doc[ok], h[ok]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = utf8(batch["text"])
        rows = []
        for i, j in blocks(offsets):
            doc, h, n = _counts(Words(data, offsets, i, j, ALNUM))
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            rows += [(h[a:b].tobytes(), n[a:b].astype(np.int32).tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "h", "n"])


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(label, text) of at most fit_rows labelled documents; label is the severity, or 0 and 1 for toxic."""
    label = "severity" if "severity" in labels.columns else "toxic"
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    share = F.lit(4.0 * fit_rows / max(1, labels.count()))  # few rows are left to sort
    rows = rows.where(hashed_share(share, "doc_id")).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("label", "text")  # fit_rows bounds it


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    ship(docs.sparkSession)
    got = sample(docs, labels, fit_rows).mapInArrow(_features, "label int, h binary, n binary").toPandas()
    y = got["label"].to_numpy(np.int64)
    hs = [np.frombuffer(x, np.uint64) for x in got["h"]]
    ns = [np.frombuffer(x, np.int32) for x in got["n"]]
    if not len(y) or y.max(initial=0) <= 0:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.array([50.0]))
    row = np.repeat(np.arange(len(y)), [len(h) for h in hs])
    vocab, col = np.unique(np.concatenate(hs), return_inverse=True)
    n = np.concatenate(ns)
    del got, hs, ns
    often = np.bincount(col) >= 3
    keep = often[col]
    vocab, row, n, col = vocab[often], row[keep], n[keep], (np.cumsum(often) - 1)[col[keep]]
    if "severity" not in labels.columns:
        y = _grades(y, row, col, n, len(vocab))
    return _solve(y, row, col, 1 + np.log(n), vocab)


def _grades(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    bad = toxic[row] > 0
    a, b = np.bincount(col[bad], minlength=width), np.bincount(col[~bad], minlength=width)
    n_bad, n_good = max(1, (toxic > 0).sum()), max(1, (toxic == 0).sum())
    mark = (a >= 5) & (a / n_bad > 20 * (b + 0.5) / n_good)
    hits = np.bincount(row, weights=n * mark[col], minlength=len(toxic))
    return np.where(toxic > 0, 1 + sum((hits >= k).astype(int) for k in GRADE_HITS), 0)


def _solve(y: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, vocab: np.ndarray) -> OrdinalModel:
    grades = np.unique(y)
    y = np.searchsorted(grades, y)
    rows, width, k = len(y), len(vocab), len(grades)
    if k < 2:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.array([50.0]))
    scale = 1 / np.sqrt(np.bincount(col, minlength=width) / rows + 0.005)
    # words whose slope at the start is far below the penalty stay at zero, so they are left out of the descent
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / rows
    rest = ((1 - share)[None, :] - (y[:, None] > np.arange(k - 1)[None, :])).sum(1)
    slope = np.abs(np.bincount(col, weights=x * scale[col] * rest[row], minlength=width)) / rows
    use = slope >= L1 / 2
    at = use[col]
    vocab, scale, row, x, col = vocab[use], scale[use], row[at], x[at], (np.cumsum(use) - 1)[col[at]]
    w, theta = _descend(y, row, col, x * scale[col], len(vocab), k, L1, 0.0)
    kept = np.flatnonzero(w)
    if not len(kept):
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), theta)
    inside = (w != 0)[col]  # the penalty has chosen the words; their weights are fitted again without its shrinkage
    again = (np.cumsum(w != 0) - 1)[col[inside]]
    w, theta = _descend(y, row[inside], again, x[inside] * scale[col[inside]], len(kept), k, 0.0, RIDGE, 8 * STEPS)
    return OrdinalModel(vocab[kept], w * scale[kept], theta)


def _descend(y, row, col, x, width: int, k: int, l1: float, l2: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient on the sum, over thresholds, of the binary
    log-likelihoods of y > threshold. The sum is convex with bounded curvature, so a fixed step is safe; when
    the objective rises the momentum starts anew."""
    rows, cuts = len(y), k - 1
    times = lambda w: np.bincount(row, weights=x * w[col], minlength=rows)
    back = lambda r: np.bincount(col, weights=x * r[row], minlength=width)
    v = np.ones(width)
    for _ in range(20):
        v = back(times(v / np.linalg.norm(v)))
    step = 1 / (0.25 * cuts * (np.linalg.norm(v) / rows * 1.1 + 1) + l2)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / rows, 1e-4, 1 - 1e-4)
    above = (y[:, None] > np.arange(cuts)[None, :]).astype(float)
    w = z = np.zeros(width)
    theta = zt = np.log(share / (1 - share))
    t, before = 1.0, np.inf
    for _ in range(steps):
        f = times(z)[:, None] - zt[None, :]
        p = 1 / (1 + np.exp(np.clip(-f, -50, 50)))
        r = p - above
        new = z - step * (back(r.sum(1)) / rows + l2 * z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = zt + step * r.sum(0) / rows
        loss = (np.logaddexp(0, f) - above * f).sum() / rows + l1 * np.abs(z).sum() + l2 / 2 * (z @ z)
        if loss > before:
            t = 1.0
        before = loss
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pace = (t - 1) / t_new
        z, zt = new + pace * (new - w), new_t + pace * (new_t - theta)
        w, theta, t = new, new_t, t_new
    if not (np.isfinite(w).all() and np.isfinite(theta).all()):
        raise FloatingPointError("the fit did not converge")
    return w, np.maximum.accumulate(theta)


def _sums(batch, model: OrdinalModel) -> np.ndarray:
    data, offsets = utf8(batch["text"])
    f = np.zeros(len(offsets) - 1)
    for i, j in blocks(offsets):
        doc, h, n = _counts(Words(data, offsets, i, j, ALNUM), model.hashes)
        w = model.weights[np.searchsorted(model.hashes, h)] if len(h) else np.empty(0)
        f[i:j] = np.bincount(doc, weights=w * (1 + np.log(n)), minlength=j - i)
    return f


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs' columns doc_id and text, with severity (expected grade), p_toxic (grade 1 or more) and grade (the likeliest)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            above = model.at_least(_sums(batch, model))
            cell = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(cell.argmax(1).astype(np.int32))], ["doc_id", "severity", "p_toxic", "grade"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, p_toxic double, grade int")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs whose probability of grade 1 or more is below limit."""
    model = fit(docs, labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(~(model.at_least(_sums(batch, model))[:, 0] >= limit)))

    return docs.mapInArrow(run, docs.schema)
