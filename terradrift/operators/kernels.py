"""All eighteen features of many series at once, in NumPy over Arrow batches.

Series of one file share their dates, so a batch is one matrix, made of its Arrow list column at once; least squares
with missing values are solved as a stack of normal equations. The SQL path gives the same values for the features it has."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.schema import FEATURES
from terradrift.ship import ship

LEAST, LEAST_HALF, LEAST_DATES = 10, 5, 20


def decimal_years(days: np.ndarray) -> np.ndarray:
    """Of days since 1970."""
    out = np.empty(len(days))
    for i, d in enumerate(days.tolist()):
        day = dt.date(1970, 1, 1) + dt.timedelta(d)
        start, end = dt.date(day.year, 1, 1), dt.date(day.year + 1, 1, 1)
        out[i] = day.year + (day - start).days / (end - start).days
    return out


def least_squares(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Coefficients (rows, terms) of y on x's columns over each row's valid places."""
    w = valid.astype(float)
    left = np.einsum("rd,di,dj->rij", w, x, x, optimize=True)
    right = np.where(valid, y, 0) @ x
    try:
        return np.linalg.solve(left, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right, strict=True)])


def _r2(rest: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.clip(1 - rest / np.maximum(total, 1e-9), -1, 1)


def features(y: np.ndarray, days: np.ndarray, jump_mm: float = 5.0) -> np.ndarray:
    """(series, 18) in the order of FEATURES, NaN for unknown. y: (series, dates), NaN for missing."""
    y = np.where(np.isfinite(y), y, np.nan)
    valid = ~np.isnan(y)
    rows, dates = y.shape
    n = valid.sum(1)
    out = np.full((rows, len(FEATURES)), np.nan)
    at = {name: k for k, name in enumerate(FEATURES)}
    out[:, at["n_valid_frac"]] = n / max(dates, 1)
    ok = n >= LEAST
    if not ok.any():
        return out
    out[:, at["v_robust"]] = out[:, at["quad_coeff"]] = 0.0  # too few values count as no motion
    out[:, [at["n_jumps"], at["jump_max_mm"]]] = 0.0
    tau = decimal_years(days)
    t = tau - tau.mean()
    v, m = y[ok], valid[ok]
    k = n[ok]
    line, curve = np.column_stack([np.ones(dates), t]), np.column_stack([np.ones(dates), t, t * t])
    wave = np.column_stack([line, np.cos(2 * np.pi * tau), np.sin(2 * np.pi * tau), np.cos(4 * np.pi * tau), np.sin(4 * np.pi * tau)])
    sums = lambda e: np.where(m, e, 0).sum(1)
    c1, c2, c6 = (least_squares(x, v, m) for x in (line, curve, wave))
    r1 = v - c1 @ line.T
    rest = r1 - (c6 @ wave.T - c6[:, :2] @ line.T)
    mean = sums(v) / k
    total, ss1, ss2, ssd = sums((v - mean[:, None]) ** 2), sums(r1**2), sums((v - c2 @ curve.T) ** 2), sums(rest**2)
    put = lambda name, value: out.__setitem__((np.flatnonzero(ok), at[name]), value)
    put("v_robust", c1[:, 1])
    put("rmse_detrended", np.sqrt(ss1 / k))
    put("velocity_r2", _r2(ss1, total))
    put("range_mm", np.nanmax(v, 1) - np.nanmin(v, 1))
    put("rmse_deseason", np.sqrt(ssd / k))
    put("seasonal_amp", np.hypot(c6[:, 2], c6[:, 3]))
    put("seasonal_r2", _r2(ssd, ss1))
    put("quad_coeff", c2[:, 2])
    put("quad_r2", np.clip((ss1 - ss2) / np.maximum(total, 1e-9), -1, 1))
    half = dates // 2
    both = (m[:, :half].sum(1) >= LEAST_HALF) & (m[:, half:].sum(1) >= LEAST_HALF)
    if both.any():
        a = least_squares(line[:half], v[both, :half], m[both, :half])[:, 1]
        b = least_squares(line[half:], v[both, half:], m[both, half:])[:, 1]
        where = np.flatnonzero(ok)[both]
        out[where, at["v_first_half"]], out[where, at["v_second_half"]], out[where, at["v_diff"]] = a, b, b - a
    # valid values moved to the front, so neighbours are neighbours in time among them
    order = np.argsort(~m, 1, kind="stable")
    take = lambda e: np.take_along_axis(e, order, 1)
    there = np.arange(dates)[None, :] < k[:, None]
    pair = there[:, 1:]
    day = take(np.broadcast_to(tau * 365.25, v.shape))
    gap = np.maximum(np.diff(day, axis=1), 1)
    step = np.where(pair, np.abs(np.diff(take(rest), axis=1)), np.nan)
    rate = step / gap
    limit = np.maximum(4 * np.nanpercentile(rate, 75, axis=1), jump_mm / 6)
    jump = pair & (rate > limit[:, None])
    put("n_jumps", jump.sum(1))
    put("jump_max_mm", np.where(jump, step, 0).max(1))
    r = np.where(there, take(r1), 0)
    r = np.where(there, r - (r.sum(1) / k)[:, None], 0)
    power = (r * r).sum(1)
    put("acf_lag1", np.where(power > 1e-9, (r[:, 1:] * r[:, :-1]).sum(1) / np.maximum(power, 1e-300), np.nan))
    sd = np.sqrt(power / k)
    walk = np.cumsum(r / np.maximum(sd, 1e-300)[:, None], 1)
    high, low = np.where(there, walk, -np.inf).max(1), np.where(there, walk, np.inf).min(1)
    put("cusum_score", np.where(sd > 1e-9, (high - low) / np.sqrt(k), np.nan))
    plain = np.where(pair, np.abs(np.diff(take(v), axis=1)), np.nan)
    put("noise_p90", np.nanpercentile(plain, 90, axis=1))
    return out


_SCHEMA = "source_file string, pid string, n_valid long, " + ", ".join(f"{f} double" for f in FEATURES)


def _matrix(lists) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column of one length as a matrix, NaN for null, and the rows that are lists of that length
    (the most frequent one's)."""
    import pyarrow as pa

    sizes = np.diff(lists.offsets.to_numpy())
    ok = ~lists.is_null().to_numpy(zero_copy_only=False)
    width = np.bincount(sizes[ok]).argmax() if ok.any() else 0
    rows = np.flatnonzero(ok & (sizes == width))
    flat = lists.take(pa.array(rows)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), width), rows


def _computed(batch, values, rows: np.ndarray, days: np.ndarray, jump_mm: float):
    import pyarrow as pa

    f = features(values, days, jump_mm)
    keys = batch.select(["source_file", "pid"]).take(pa.array(rows))
    columns = [*keys.columns, pa.array(np.isfinite(values).sum(1))] + [pa.array(np.ascontiguousarray(c), from_pandas=True) for c in f.T]
    return pa.RecordBatch.from_arrays(columns, ["source_file", "pid", "n_valid", *FEATURES])


def wide_features(wide: DataFrame, jump_mm: float = 5.0) -> DataFrame:
    """source_file, pid, n_valid and the features of a wide table, whose dates are its YYYYMMDD columns. Each row becomes an array
    where it is read, so nothing is shuffled. Tables with fewer than LEAST_DATES dates give no rows."""
    from terradrift.functions.scalars import finite

    ship(wide.sparkSession)
    dates = sorted(c for c in wide.columns if len(c) == 8 and c.isdigit())
    days = np.array([dt.datetime.strptime(d, "%Y%m%d").date().toordinal() - dt.date(1970, 1, 1).toordinal() for d in dates])
    if len(dates) < LEAST_DATES:
        return wide.sparkSession.createDataFrame([], _SCHEMA)

    def run(batches):
        for batch in batches:
            if len(batch):
                values, rows = _matrix(batch["values"])
                yield _computed(batch, values.astype(float), rows, days, jump_mm)

    arrays = wide.select("source_file", "pid", F.array(*[finite(F.col(d)).cast("double") for d in dates]).alias("values"))
    return arrays.mapInArrow(run, _SCHEMA)


def kernel_features(arrays: DataFrame, jump_mm: float = 5.0) -> DataFrame:
    """The same of rows with dates and values arrays, which may differ in their dates. Rows with fewer than LEAST_DATES dates are
    left out."""
    ship(arrays.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left = batch
            while len(left):
                days, rows = _matrix(left["dates"].cast(pa.list_(pa.int32())))
                if not len(rows):
                    break
                alike = rows[(days == days[0]).all(1)] if days.shape[1] else rows
                if not len(alike):  # a missing date
                    alike, days = rows, days[:, :0]
                part = left.take(pa.array(alike))
                values, here = _matrix(part["values"])
                if days.shape[1] >= LEAST_DATES and values.shape[1] == days.shape[1]:
                    yield _computed(part, values.astype(float), here, days[0].astype(int), jump_mm)
                rest = np.ones(len(left), bool)
                rest[alike] = False
                left = left.filter(pa.array(rest))

    return arrays.select("source_file", "pid", "dates", "values").mapInArrow(run, _SCHEMA)
