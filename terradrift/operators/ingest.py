"""Raw deliveries to typed points and long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.functions import geometry
from terradrift.functions.scalars import bare_date, finite, number, orbit


def date_columns(names: Sequence[str]) -> dict[str, str]:
    """Date columns of a header to their YYYYMMDD names."""
    return {n: b for n in names if (b := bare_date(n)) is not None}


def check_header(names: Sequence[str]) -> tuple[list[str], dict[str, str], list[str]]:
    """Metadata, date and ignored columns; raises where required ones or all dates are missing."""
    dates = date_columns(names)
    missing = [c for c in schema.REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if not dates:
        raise ValueError("no date columns")
    meta = [c for c in schema.META_TYPES if c in names]
    return meta, dates, [n for n in names if n not in meta and n not in dates]


def coerce(raw: DataFrame) -> DataFrame:
    """Text columns to their types; what cannot be read becomes null. Dates lose their prefix."""
    meta, dates, _ = check_header(raw.columns)
    columns = []
    for name in meta:
        kind = schema.META_TYPES[name].simpleString()
        columns.append((F.col(name) if kind == "string" else finite_or(number(F.col(name), kind), kind)).alias(name))
    columns += [finite(number(F.col(f"`{n}`"), "float")).alias(bare) for n, bare in dates.items()]
    extra = [c for c in ("source_file",) if c in raw.columns]
    return raw.select(*extra, *columns)


def finite_or(value, kind: str):
    return finite(value) if kind in ("float", "double") else value


def gap_metrics(axis: DataFrame) -> DataFrame:
    """source_file, max_gap_days, n_acquisitions of a date axis (source_file, acq_date). Dates are sorted first."""
    before = F.lag("acq_date").over(Window.partitionBy("source_file").orderBy("acq_date"))
    gaps = axis.select("source_file", "acq_date", F.datediff("acq_date", before).alias("gap"))
    out = gaps.groupBy("source_file").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("g"), F.count("acq_date").alias("n"))
    return out.select("source_file", F.col("g").cast("smallint").alias("max_gap_days"), F.col("n").cast("smallint").alias("n_acquisitions"))


def in_box(df: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """box: west, south, east, north, all inclusive."""
    if box is None:
        return df
    west, south, east, north = box
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("a box needs west < east and south < north, in degrees")
    return df.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def quality(min_coherence: float | None = None, velocity_limit: float | None = None):
    """Whether a point passes; null where a needed value is missing, and true without any limit."""
    keep = F.lit(True)
    if min_coherence is not None:
        keep = keep & (F.col("temporal_coherence") >= min_coherence)
    if velocity_limit is not None:
        keep = keep & (F.abs("mean_velocity") <= velocity_limit)
    return keep


def rejected(df: DataFrame, min_coherence: float | None = None, velocity_limit: float | None = None) -> DataFrame:
    """n_points and n_filtered of the rows inside the box."""
    keep = F.coalesce(quality(min_coherence, velocity_limit), F.lit(False))
    return df.agg(F.count_if(keep).alias("n_points"), F.count_if(~keep).alias("n_filtered"))


def points(typed: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Point table with orbit, gaps, geometry and its covering box, without the date columns."""
    meta = [c for c in typed.columns if c in schema.META_TYPES or c == "source_file"]
    out = typed.select(*meta, orbit(F.col("track_angle")).alias("orbit"))
    if gaps is not None:
        out = out.join(F.broadcast(gaps), "source_file", "left")  # a row a file
    x, y = F.col("longitude"), F.col("latitude")
    box = F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    return out.withColumns({"geometry": geometry.point_wkb(x, y), "bbox": box})


def convert(raw: DataFrame, min_coherence: float | None = None, velocity_limit: float | None = None, box=None) -> tuple[DataFrame, DataFrame]:
    """Points and wide series of a raw delivery with a source_file column. The box applies before the limits."""
    typed = in_box(coerce(raw), box).where(quality(min_coherence, velocity_limit))
    dates = sorted(date_columns(raw.columns).values())
    axis = raw.sparkSession.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d", "yyyyMMdd").alias("acq_date"))
    gaps = gap_metrics(axis.withColumn("source_file", F.lit("all"))).drop("source_file")
    found = points(typed).join(F.broadcast(gaps))  # one row
    return found, typed.select("source_file", "pid", *dates)


def verify_pair(meta: DataFrame, series: DataFrame) -> DataFrame:
    """One row: keys on one side only, duplicates, orbit values, velocity and coherence ranges."""
    keys = ["source_file", "pid"]
    a, b = meta.select(*keys), series.select(*keys)
    only_meta = a.join(b, keys, "left_anti").agg(F.count("*").alias("only_meta"))
    only_series = b.join(a, keys, "left_anti").agg(F.count("*").alias("only_series"))
    twice = a.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_duplicates"))
    stats = meta.agg(
        F.count("*").alias("n_points"),
        F.count("orbit").alias("n_orbit"),
        F.min("mean_velocity").alias("vel_min"),
        F.max("mean_velocity").alias("vel_max"),
        F.avg("mean_velocity").alias("vel_mean"),
        F.min("temporal_coherence").alias("coh_min"),
        F.max("temporal_coherence").alias("coh_max"),
    )
    for one in (only_meta, only_series, twice):
        stats = stats.crossJoin(F.broadcast(one))  # single rows
    return stats.withColumn("same_keys", (F.col("only_meta") == 0) & (F.col("only_series") == 0))
