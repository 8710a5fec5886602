"""Series between wide, long and array form, and their features in SQL.

The SQL features need one aggregate per series plus one ordered window; t is the decimal year minus the
mean over all dates of the file, so moments don't cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradrift.functions.scalars import decimal_year, finite

KEY = ("source_file", "pid")


def to_long(wide: DataFrame) -> DataFrame:
    """source_file, pid, acq_date, disp of a wide table; missing values stay as null rows."""
    dates = sorted(c for c in wide.columns if len(c) == 8 and c.isdigit())
    out = wide.unpivot(list(KEY), dates, "d", "disp")
    return out.select(*KEY, F.to_date("d", "yyyyMMdd").alias("acq_date"), finite(F.col("disp")).alias("disp"))


def to_wide(long: DataFrame, dates: list[str]) -> DataFrame:
    """The reverse, for the given YYYYMMDD names."""
    return long.withColumn("d", F.date_format("acq_date", "yyyyMMdd")).groupBy(*KEY).pivot("d", dates).agg(F.first("disp", ignorenulls=True))


def to_arrays(long: DataFrame) -> DataFrame:
    """source_file, pid, dates array<date>, values array<double> by date."""
    rows = long.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("acq_date", F.col("disp").cast("double").alias("disp")))).alias("s"))
    return rows.select(*KEY, F.col("s.acq_date").alias("dates"), F.col("s.disp").alias("values"))


def timeseries(long: DataFrame, pid: str, digits: int = 2) -> DataFrame:
    """The series of one point: pid, dates as text, values rounded, nulls kept. The filter reaches the scan."""
    one = to_arrays(long.where(F.col("pid") == F.lit(pid)))
    return one.select("source_file", "pid", F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd")).alias("dates"), F.transform("values", lambda v: F.round(v, digits)).alias("values"))


def date_axis(long: DataFrame) -> DataFrame:
    """source_file, acq_date, pos (0, 1, ...), n_dates, t_year, t (centred) of every date of a file."""
    dates = long.select("source_file", "acq_date").distinct()
    by = Window.partitionBy("source_file")
    t = decimal_year(F.col("acq_date"))
    pos = (F.row_number().over(by.orderBy("acq_date")) - 1).alias("pos")
    return dates.select("source_file", "acq_date", pos, F.count("*").over(by).alias("n_dates"), t.alias("t_year"), (t - F.avg(t).over(by)).alias("t"))


def on_axis(long: DataFrame) -> DataFrame:
    """Long rows with their axis. The axis has a row per file and date; Spark broadcasts it while it is small."""
    return long.join(date_axis(long), ["source_file", "acq_date"])


def _slope(y: Column, t: Column, when: Column | None = None) -> Column:
    use = y.isNotNull() if when is None else when & y.isNotNull()
    x, v = F.when(use, t), F.when(use, y)
    n = F.count(v)
    sx, sy, sxy, sxx = F.sum(x), F.sum(v), F.sum(x * v), F.sum(x * x)
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def sql_features(rows: DataFrame, least: int = 10, least_half: int = 5, digits: int | None = None) -> DataFrame:
    """Features that SQL expresses, per series of rows as on_axis gives them: slopes, detrended RMSE, quadratic fit,
    valid fraction, range, autocorrelation, cumulative sum score, difference noise."""
    y, t = F.col("disp").cast("double"), F.col("t")
    rows = rows.withColumn("y", y)
    first = F.col("pos") < F.floor(F.col("n_dates") / 2)
    y = F.col("y")
    s = lambda e: F.sum(F.when(F.col("y").isNotNull(), e))
    moments = {"n": F.count("y"), "n_dates": F.max("n_dates"), "sy": F.sum("y"), "syy": F.sum(y * y), "lo": F.min("y"), "hi": F.max("y")}
    moments |= {f"s{k}": s(F.pow(t, F.lit(float(k)))) for k in (1, 2, 3, 4)}
    moments |= {"sty": F.sum(t * y), "stty": F.sum(t * t * y)}
    moments |= {"a": _slope(y, t, first), "b": _slope(y, t, ~first), "na": F.count(F.when(first, y)), "nb": F.count(F.when(~first, y))}
    m = rows.groupBy(*KEY).agg(*[e.alias(k) for k, e in moments.items()])
    c = {k: F.col(k) for k in moments}
    slope = F.try_divide(c["n"] * c["sty"] - c["s1"] * c["sy"], c["n"] * c["s2"] - c["s1"] * c["s1"])
    m = m.withColumn("slope", slope).withColumn("inter", (c["sy"] - F.col("slope") * c["s1"]) / c["n"])
    m = m.withColumn("sst", c["syy"] - c["sy"] * c["sy"] / c["n"])
    m = m.withColumn("ssr", F.greatest(F.lit(0.0), c["syy"] - F.col("inter") * c["sy"] - F.col("slope") * c["sty"]))
    # the 3 x 3 normal equations of the quadratic by Cramer's rule
    n, s1, s2, s3, s4 = c["n"], c["s1"], c["s2"], c["s3"], c["s4"]
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    q0 = c["sy"] * (s2 * s4 - s3 * s3) - s1 * (c["sty"] * s4 - s3 * c["stty"]) + s2 * (c["sty"] * s3 - s2 * c["stty"])
    q1 = n * (c["sty"] * s4 - c["stty"] * s3) - c["sy"] * (s1 * s4 - s3 * s2) + s2 * (s1 * c["stty"] - c["sty"] * s2)
    q2 = n * (s2 * c["stty"] - s3 * c["sty"]) - s1 * (s1 * c["stty"] - s2 * c["sty"]) + c["sy"] * (s1 * s3 - s2 * s2)
    m = m.withColumns({"q0": F.try_divide(q0, det), "q1": F.try_divide(q1, det), "q2": F.try_divide(q2, det)})
    m = m.withColumn("ssq", F.greatest(F.lit(0.0), c["syy"] - F.col("q0") * c["sy"] - F.col("q1") * c["sty"] - F.col("q2") * c["stty"]))
    walk = _ordered(rows.where("y is not null").join(m.select(*KEY, "slope", "inter", "n", "ssr"), list(KEY)))
    m = m.join(walk, list(KEY), "left")
    ok = F.col("n") >= least
    clip = lambda e: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e))
    half = (F.col("na") >= least_half) & (F.col("nb") >= least_half) & ok
    out = {
        "v_robust": F.when(ok, F.col("slope")),
        "v_first_half": F.when(half, F.col("a")),
        "v_second_half": F.when(half, F.col("b")),
        "v_diff": F.when(half, F.col("b") - F.col("a")),
        "rmse_detrended": F.when(ok, F.sqrt(F.col("ssr") / F.col("n"))),
        "quad_coeff": F.when(ok, F.col("q2")),
        "quad_r2": F.when(ok, clip((F.col("ssr") - F.col("ssq")) / F.greatest(F.col("sst"), F.lit(1e-9)))),
        "n_valid_frac": F.col("n") / F.col("n_dates"),
        "acf_lag1": F.when(ok, F.col("acf")),
        "cusum_score": F.when(ok, F.col("cusum")),
        "velocity_r2": F.when(ok, clip(1 - F.col("ssr") / F.greatest(F.col("sst"), F.lit(1e-9)))),
        "range_mm": F.when(ok, F.col("hi") - F.col("lo")),
        "noise_p90": F.when(ok, F.col("p90")),
    }
    exact = {"range_mm", "noise_p90"}  # differences of values with few decimals, which could lie on the edge of rounding
    shown = {k: F.round(v, max(10, digits) if k in exact else digits) if digits is not None else v for k, v in out.items()}
    return m.select(*KEY, F.col("n").alias("n_valid"), *[v.alias(k) for k, v in shown.items()])


def _ordered(rows: DataFrame) -> DataFrame:
    """acf, cusum and p90 from residuals in date order."""
    by = Window.partitionBy(*KEY).orderBy("pos")
    r = F.col("y") - F.col("inter") - F.col("slope") * F.col("t")
    rows = rows.withColumn("r", r).withColumn("r0", F.lag("r").over(by)).withColumn("dy", F.abs(F.col("y") - F.lag("y").over(by)))
    sd = F.sqrt(F.col("ssr") / F.col("n"))
    rows = rows.withColumn("walk", F.sum(F.try_divide(F.col("r"), sd)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    power = F.sum(F.col("r") * F.col("r"))
    p90 = F.percentile("dy", F.lit(0.9))
    return rows.groupBy(*KEY).agg(
        F.when((power > 1e-9) & (F.count("*") >= 4), F.sum(F.col("r") * F.col("r0")) / power).alias("acf"),
        F.when((F.count("*") >= 6) & (F.max(sd) > 1e-9), (F.max("walk") - F.min("walk")) / F.sqrt(F.count("*"))).alias("cusum"),
        F.when(F.count("*") >= 4, p90).alias("p90"),
    )
