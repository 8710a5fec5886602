"""Questions of a map viewer: points in view, one series, dataset summary, polygons as GeoJSON, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.functions.geometry import feature_rows
from terradrift.operators.series import timeseries

MAX_POINTS = 200_000


def points_in_view(
    points: DataFrame,
    min_lat: float = -90,
    max_lat: float = 90,
    min_lon: float = -180,
    max_lon: float = 180,
    thresh: float = 2.5,
    min_coh: float = 0,
    asc: bool = True,
    desc: bool = True,
    zoom: int = 14,
    max_pts: int = MAX_POINTS,
) -> DataFrame:
    """The most coherent point of each grid cell (then the least pid), at most max_pts, with the count before thinning.

    |v| >= thresh is written as two ranges, so all filters reach the scan. The best point of a cell is an
    aggregate, combined on the map side, not a window over the cell's points."""
    orbits = [o for o, on in (("A", asc), ("D", desc)) if on]
    cell = schema.cell_degrees(zoom)
    rows = points.where(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon))
    rows = rows.where((F.col("mean_velocity") >= thresh) | (F.col("mean_velocity") <= -thresh)).where(F.col("temporal_coherence") >= min_coh)
    rows = rows.where(F.col("orbit").isin(orbits)) if orbits else rows.limit(0)
    has = set(points.columns)
    shown = {
        "pid": F.col("pid"),
        "latitude": F.col("latitude"),
        "longitude": F.col("longitude"),
        "mean_velocity": F.round(F.col("mean_velocity").cast("double"), 2),
        "temporal_coherence": F.round(F.col("temporal_coherence").cast("double"), 3),
        "orbit": F.col("orbit").cast("string"),
        "max_gap_days": F.coalesce("max_gap_days", F.lit(0)) if "max_gap_days" in has else F.lit(0),
    }
    if "class_1" in has:
        shown["class_1"] = F.coalesce("class_1", F.lit(schema.UNCLASSIFIED))
        shown["class_2"] = F.coalesce("class_2", F.lit(schema.UNCLASSIFIED)) if "class_2" in has else F.lit(schema.UNCLASSIFIED)
        shown["class_prob_1"] = F.coalesce("class_prob_1", F.lit(0.0)) if "class_prob_1" in has else F.lit(0.0)
    for flag in ("periodic", "jumpy", "variable_flag", "noisy_trend"):
        if "class_1" in has:
            shown[flag] = F.coalesce(flag, F.lit(False)) if flag in has else F.lit(False)
    for name in ("cluster_id", "subcluster_id"):
        if name in has:
            shown[name] = F.col(name)
    grid = [F.floor(F.col("latitude") / cell).alias("row"), F.floor(F.col("longitude") / cell).alias("col")]
    order = F.struct((-F.col("temporal_coherence")).alias("c"), F.col("pid").alias("p"))
    best = F.min_by(F.struct(*[e.alias(k) for k, e in shown.items()]), order)
    thin = rows.groupBy(*grid).agg(best.alias("b")).select("b.*").orderBy("pid").limit(max_pts)
    total = rows.agg(F.count("*").alias("total_count"))
    return thin.crossJoin(F.broadcast(total))  # one row


def dataset_info(points: DataFrame) -> DataFrame:
    """One row: counts, orbit counts, velocity, coherence and the bounding box."""
    v, c = F.col("mean_velocity").cast("double"), F.col("temporal_coherence").cast("double")
    orbit = F.col("orbit")
    return points.agg(
        F.count("*").alias("total_points"),
        *[F.count_if(orbit == o).alias(f"orbit_{o.lower()}") for o in ("A", "D", "U")],
        F.round(F.min(v), 2).alias("vel_min"),
        F.round(F.max(v), 2).alias("vel_max"),
        F.round(F.avg(v), 2).alias("vel_mean"),
        F.round(F.stddev_samp(v), 2).alias("vel_stddev"),
        F.round(F.min(c), 3).alias("coh_min"),
        F.round(F.max(c), 3).alias("coh_max"),
        *[F.round(f(x), 4).alias(n) for f, x, n in ((F.min, "longitude", "min_lon"), (F.max, "longitude", "max_lon"), (F.min, "latitude", "min_lat"), (F.max, "latitude", "max_lat"))],
    )


def orbit_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("orbit").agg(F.count("*").alias("n")).orderBy("orbit")


def point_series(points: DataFrame, long: DataFrame, pid: str, corrected: DataFrame | None = None) -> DataFrame:
    """One point's series beside its metadata; corrected series where they are given and asked for."""
    source = long if corrected is None else corrected
    one = timeseries(source, pid)
    meta = points.where(F.col("pid") == F.lit(pid))
    out = one.join(meta, ["source_file", "pid"])
    if "gap_info" in points.columns:
        out = out.withColumn("gap_info", F.from_json("gap_info", "map<string,string>"))
    return out.withColumn("corrected", F.lit(corrected is not None))


def geojson(polygons: DataFrame) -> DataFrame:
    """A feature a row; joined with commas inside a FeatureCollection they are the file."""
    return feature_rows(polygons)


def health(points: DataFrame) -> DataFrame:
    return points.agg(F.lit("ok").alias("status"), F.count("*").alias("points"))


def best_per_cell(points: DataFrame, cell: float) -> DataFrame:
    """The thinning as a window, for callers who need every column."""
    w = Window.partitionBy(F.floor(F.col("latitude") / cell), F.floor(F.col("longitude") / cell)).orderBy(F.desc_nulls_last("temporal_coherence"), "pid")
    return points.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
