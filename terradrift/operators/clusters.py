"""Cluster summaries, polygons, roll-ups, and ids written back to points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.functions.geometry import area_centroid, convex_hull, hull_ring, polygon_wkb
from terradrift.functions.scalars import class_color, cluster_id, subcluster_id
from terradrift.ship import ship


def load_eligible(points: DataFrame, min_velocity: float = 2.5, min_coherence: float = 0.5, exclude: tuple[str, ...] = ("unclassified", "stable", "noisy")) -> DataFrame:
    """Points to cluster; the limits test unrounded values, the result's velocity has two and its coherence three digits.
    Metric coordinates come from the columns, or from longitude and latitude where those are missing."""
    from terradrift.functions.geometry import project

    if "class_1" not in points.columns:
        points = points.withColumn("class_1", F.lit(None).cast("string"))
    if not {"easting", "northing"} <= set(points.columns):
        xy = project(F.col("longitude"), F.col("latitude"))
        points = points.withColumn("__xy", xy).withColumns({"easting": F.col("__xy.easting"), "northing": F.col("__xy.northing")}).drop("__xy")
    name = F.coalesce("class_1", F.lit(schema.UNCLASSIFIED))
    keep = (F.col("temporal_coherence") >= min_coherence) & (F.abs("mean_velocity") >= min_velocity) & ~name.isin(list(exclude))
    return points.where(keep).select(
        "source_file",
        "pid",
        F.col("easting").cast("double").alias("e"),
        F.col("northing").cast("double").alias("n"),
        F.round(F.col("mean_velocity").cast("double"), 2).alias("v"),
        F.round(F.col("temporal_coherence").cast("double"), 3).alias("coherence"),
        name.alias("class_1"),
    )


def majority(members: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, dom_class, class_purity: the most frequent value, of equal ones the first in order."""
    counts = members.groupBy(*by, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    top = counts.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), F.asc_nulls_last(name))), "total": F.sum("n").over(w)}).where("r = 1")
    return top.select(*by, F.col(name).alias("dom_class"), F.round(F.col("n") / F.col("total"), 3).alias("class_purity"))


def summarise(members: DataFrame, min_purity: float = 0.5, digits: int = 2) -> DataFrame:
    """One row a cluster, without geometry. members: label >= 0, e, n, v, coherence, class_1."""
    m = members.where("label >= 0")
    stats = m.groupBy("label").agg(
        F.count("*").alias("n_points"),
        F.round(F.avg("v"), digits).alias("vel_mean"),
        F.round(F.stddev_pop("v"), digits).alias("vel_std"),
        F.round(F.min("v"), digits).alias("vel_min"),
        F.round(F.max("v"), digits).alias("vel_max"),
        F.round(F.avg("coherence"), digits + 1).alias("coh_mean"),
    )
    out = stats.join(majority(m, ["label"], "class_1"), "label")
    mixed = F.col("class_purity") < min_purity
    return out.select(cluster_id(F.col("label")).alias("cluster_id"), "n_points", "dom_class", "class_purity", mixed.alias("is_mixed"), "vel_mean", "vel_std", "vel_min", "vel_max", "coh_mean", class_color(F.when(mixed, "mixed").otherwise(F.col("dom_class"))).alias("color"), "label")


def polygons(members: DataFrame, by: list[str], radius: float = 20.0, segments: int = 32) -> DataFrame:
    """by, area_m2, area_ha, centroid_e, centroid_n, geometry of the buffered hull of each group with label >= 0.

    A group's hull is the hull of hulls: rows are first reduced to corners per salted part, so no task holds a
    whole large group."""
    ship(members.sparkSession)
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in by)

    def corners(pdf):
        import pandas as pd

        found = convex_hull(pdf[["e", "n"]].to_numpy(float))
        out = pd.DataFrame(found, columns=["e", "n"])
        for c in by:
            out[c] = pdf[c].iloc[0]
        out["points"] = [len(pdf)] + [0] * (len(out) - 1)
        return out[[*by, "e", "n", "points"]]

    def ring(pdf):
        import pandas as pd

        pts = pdf[["e", "n"]].to_numpy(float)
        if pdf["points"].sum() > 2 or len(pts) < 2:
            ring_ = hull_ring(np.repeat(pts, 3, 0) if pdf["points"].sum() > 2 and len(pts) < 3 else pts, radius, segments)
        else:
            ring_ = hull_ring(pts, radius, segments)
        area, x, y = area_centroid(ring_)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "area_m2": [round(area, 1)], "area_ha": [round(area / 1e4, 4)], "centroid_e": [round(x, 1)], "centroid_n": [round(y, 1)], "geometry": [polygon_wkb(ring_)]})

    salted = members.where("label >= 0").select(*by, "e", "n").withColumn("salt", F.pmod(F.xxhash64("e", "n"), F.lit(64)))
    part = salted.groupBy(*by, "salt").applyInPandas(corners, f"{kinds}, e double, n double, points long")
    return part.groupBy(*by).applyInPandas(ring, f"{kinds}, area_m2 double, area_ha double, centroid_e double, centroid_n double, geometry binary")


def rollup(summary: DataFrame, area: str | None = "area_m2") -> DataFrame:
    """Clusters, points and mean area per dominant class."""
    extra = [F.avg(area).alias("mean_area")] if area else []
    return summary.groupBy("dom_class").agg(F.count("*").alias("n_clusters"), F.sum("n_points").alias("total_pts"), *extra)


def totals(assigned: DataFrame) -> DataFrame:
    """n_clusters, n_clustered, n_noise, avg_size of rows with cluster_id."""
    noise = F.col("cluster_id") == schema.NOISE
    out = assigned.agg(F.countDistinct(F.when(~noise, F.col("cluster_id"))).alias("n_clusters"), F.count_if(~noise).alias("n_clustered"), F.count_if(noise).alias("n_noise"))
    return out.withColumn("avg_size", F.col("n_clustered") / F.greatest(F.col("n_clusters"), F.lit(1)))


def with_cluster_ids(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """points with cluster_id in place of any it has; NOISE where nothing is assigned."""
    found = assigned.select("source_file", "pid", "cluster_id").dropDuplicates(["source_file", "pid"])
    return points.drop("cluster_id").join(found, ["source_file", "pid"], "left").fillna({"cluster_id": schema.NOISE})


def with_subcluster_ids(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """points with subcluster_id; null where nothing is assigned, the least id where several are."""
    found = assigned.groupBy("source_file", "pid").agg(F.min("subcluster_id").alias("subcluster_id"))
    return points.drop("subcluster_id").join(found, ["source_file", "pid"], "left")


def subclusters(points: DataFrame, classes: tuple[str, ...], eps_m: float = 50.0, eps_vel: float = 2.0, min_samples: int = 3) -> DataFrame:
    """idx, cluster_id, class_1, label, subcluster_id. points: idx, cluster_id, class_1, e, n, v. Labels restart in
    each (cluster, class); a group below min_samples is all noise."""
    from terradrift.operators.dbscan import dbscan

    use = points.where((F.col("cluster_id") != schema.NOISE) & F.col("class_1").isin(list(classes)))
    found = dbscan(use, eps_m, eps_vel, min_samples, ("cluster_id", "class_1"), 0.01)
    return found.withColumn("subcluster_id", subcluster_id(F.col("cluster_id"), F.col("label")))
