"""The whole path over folders: convert, classify, cluster, subcluster. Each step writes new tables keyed by
(source_file, pid) beside the converted files and leaves what it reads as it is."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift import schema
from terradrift.functions.geometry import to_degrees
from terradrift.functions.scalars import cluster_id, subcluster_id
from terradrift.operators import classify as rules
from terradrift.operators import clusters, ingest, mixture, series
from terradrift.operators.dbscan import dbscan
from terradrift.operators.kernels import wide_features
from terradrift.schema import FEATURES
from terradrift.sources import readers, sinks
from terradrift.streaming.incremental import pending
from terradrift.tables import Stage, numbered

KEY = ["source_file", "pid"]


#: Points of one file of a converted delivery, about; larger ones become several parts.
FILE_POINTS = 5_000_000
_PART = r"(\.part[0-9]{4})?"


def convert(spark: SparkSession, input_dir: str, out_dir: str, compression: str = "snappy", min_coherence: float | None = None, velocity_limit: float | None = None, box=None, force: bool = False, verify: bool = True) -> DataFrame:
    """Pairs <stem>_meta.parquet and <stem>_ts.parquet of each raw file; a row a file: source_file, status (ok, error or
    skipped), n_points, in_bytes, out_bytes and message. Files are taken together where their headers agree; those already
    converted are skipped unless forced. A header that lacks what is needed fails its own files only. With verify, each pair is read
    again: its keys must agree, without repeats, and the metadata must be a GeoParquet file with as many rows as were written."""
    csvs = readers.list_files(spark, input_dir, ".csv", ".txt")
    names = lambda files: {f.rsplit("/", 1)[-1]: f for f in files}
    stage, done, rows = Stage(spark, "convert"), [], []
    if csvs:
        todo = pending(spark, input_dir, out_dir, force)
        rows += [(f, "skipped", None, None, "already converted") for f in sorted(set(names(csvs)) - set(names(todo)))]
        groups: dict[tuple, list[str]] = {}
        for f in todo:
            groups.setdefault(tuple(readers.header(spark, f)), []).append(f)
        raws = [(head, names(files), lambda files=files: readers.read_csv(spark, files)) for head, files in groups.items()]
    else:
        lines, bad = readers.read_zip(spark, readers.list_files(spark, input_dir, ".zip"))
        rows += [(r["source_file"], "error", None, None, r["error"]) for r in bad.collect()]  # a row an archive
        raw = readers.csv_from_lines(lines)
        raws = [(tuple(c for c in raw.columns if c != "source_file"), {}, lambda: raw)]
    for k, (head, files, read) in enumerate(raws):
        try:
            ingest.check_header(head)
            done.append(_convert(spark, stage.kept(f"group-{k}"), read(), head, out_dir, compression, min_coherence, velocity_limit, box))
        except Exception as e:  # reported with the files that it concerns; the others go on
            if not files:
                raise
            rows += [(f, "error", None, None, str(e)[:500]) for f in sorted(files)]
    found = {}
    for df in done:
        for r in df.collect():  # a row a written file
            n, size = found.get(r["source_file"], (0, 0))
            found[r["source_file"]] = n + r["n"], size + r["bytes"]
    source = readers.sizes(spark, csvs)
    source = {f.rsplit("/", 1)[-1]: n for f, n in source.items()}
    rows += [(f, "ok", n, size, None) for f, (n, size) in sorted(found.items())]
    for head, files, _ in raws:  # all rows of a file may lie outside the limits
        rows += [(f, "ok", 0, 0, "no point within the limits") for f in sorted(set(files) - {r[0] for r in rows})]
    if verify and found:
        bad = verify_pairs(spark, out_dir, {f: n for f, (n, _) in found.items()})
        rows = [(f, "error", n, size, bad[f]) if f in bad else (f, status, n, size, message) for f, status, n, size, message in rows]
    shaped = [(f, status, n, source.get(f), size, message) for f, status, n, size, message in rows]
    return spark.createDataFrame(shaped, "source_file string, status string, n_points long, in_bytes long, out_bytes long, message string")


def _convert(spark: SparkSession, stage: Stage, raw: DataFrame, head: Sequence[str], out_dir: str, compression: str, min_coherence, velocity_limit, box) -> DataFrame:
    """source_file, n (of metadata files) and bytes of each file written."""
    points, wide = ingest.convert(raw, min_coherence, velocity_limit, box)
    points = stage.keep(points, "points")
    dates = sorted(ingest.date_columns(head).values())
    counts = points.groupBy("source_file").agg(F.count("*").alias("n"), F.first("max_gap_days").alias("gap")).collect()  # a row a file
    foot = {r["source_file"]: sinks.footer(dates, r["source_file"], r["n"], r["gap"], min_coherence, velocity_limit) for r in counts}
    parts = {r["source_file"]: -(-r["n"] // FILE_POINTS) for r in counts}
    meta = stage.keep(sinks.write_files(points, out_dir, "_meta.parquet", foot, compression, parts, "Point"), "meta")
    ts = stage.keep(sinks.write_files(wide, out_dir, "_ts.parquet", foot, compression, parts), "ts")
    both = meta.unionByName(ts.withColumn("n", F.lit(0).cast("long"))).collect()  # two rows a file
    files, _ = sinks.store(out_dir)
    return spark.createDataFrame([(r["source_file"], r["n"], files.get_file_info(r["path"]).size) for r in both], "source_file string, n long, bytes long")


def verify_pairs(spark: SparkSession, out_dir: str, expected: dict[str, int]) -> dict[str, str]:
    """What is wrong with the pairs of these sources (file name: points), by source."""
    stems = {f.rsplit(".", 1)[0]: f for f in expected}
    points, keys = read_points(spark, out_dir), None
    for files in readers.by_columns(spark, readers.list_files(spark, out_dir, "_ts.parquet", recursive=True)):
        df = _stem(spark.read.parquet(*files).select("pid", readers.file_name()), "_ts.parquet")
        keys = df if keys is None else keys.unionByName(df)
    if keys is None:
        return {f: "no series" for f in expected}
    sided = points.select(*KEY, F.lit(1).alias("m"), F.lit(0).alias("s")).unionByName(keys.select(*KEY, F.lit(0).alias("m"), F.lit(1).alias("s")))
    each = sided.groupBy(*KEY).agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    found = each.groupBy("source_file").agg(F.sum("m").alias("n"), F.count_if(F.expr("s = 0")).alias("only_meta"), F.count_if(F.expr("m = 0")).alias("only_series"), F.count_if(F.expr("m > 1")).alias("repeats"))
    got, out = {r["source_file"]: r for r in found.collect()}, {}  # a row a file
    for stem, f in stems.items():
        r = got.get(stem)
        if r is None or r["n"] != expected[f]:
            out[f] = f"{r['n'] if r else 0} points found of {expected[f]}"
        elif r["only_meta"] or r["only_series"] or r["repeats"]:
            out[f] = f"{r['only_meta']} points without series, {r['only_series']} series without point, {r['repeats']} repeated"
    for path in readers.list_files(spark, out_dir, "_meta.parquet", recursive=True):
        f = stems.get(re.sub(r"(\.part[0-9]{4})?_meta\.parquet$", "", path.rsplit("/", 1)[-1]))
        if f and sinks.geo_epsg({k.encode(): v for k, v in readers.parquet_columns(spark, path)[1].items()}) is None:
            out.setdefault(f, "no coordinate system")
    return out


def batch_totals(report: DataFrame) -> DataFrame:
    """One row over a conversion's report: n_processed, n_skipped, n_errors, total_points, in_mb, out_mb, saving_pct."""
    of = lambda s: F.count_if(F.col("status") == s)
    megabytes = lambda c: F.coalesce(F.sum(c), F.lit(0)) / F.lit(1e6)
    ok = F.col("status") == "ok"
    out = report.agg(of("ok").alias("n_processed"), of("skipped").alias("n_skipped"), of("error").alias("n_errors"), F.coalesce(F.sum(F.when(ok, F.col("n_points"))), F.lit(0)).alias("total_points"), megabytes("in_bytes").alias("in_mb"), megabytes("out_bytes").alias("out_mb"))
    return out.withColumn("saving_pct", F.when(F.col("in_mb") > 0, 100.0 * (1 - F.col("out_mb") / F.col("in_mb"))).otherwise(0.0))


def _stem(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumn("source_file", F.regexp_replace("source_file", f"{_PART}{suffix}$", ""))


def read_points(spark: SparkSession, data_dir: str) -> DataFrame:
    return _stem(readers.read_parquet_by_name(spark, data_dir, "_meta.parquet"), "_meta.parquet")


def _wide(spark: SparkSession, data_dir: str, suffix: str, files: list[str] | None = None) -> list[DataFrame]:
    """Wide series, a table for each set of dates."""
    files = readers.list_files(spark, data_dir, suffix, recursive=True) if files is None else files
    return [_stem(spark.read.parquet(*group).select("*", readers.file_name()), suffix) for group in readers.by_columns(spark, files)]


def read_series(spark: SparkSession, data_dir: str, suffix: str = "_ts.parquet") -> DataFrame:
    """Long series of all files; files are read per schema, so each keeps its own dates."""
    out = None
    for wide in _wide(spark, data_dir, suffix):
        df = series.to_long(wide)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no series")
    return out


def series_features(spark: SparkSession, data_dir: str, files: list[str] | None = None, jump_mm: float = 5.0) -> DataFrame:
    """The kernel's features of all series, made where their files are read."""
    out = None
    for wide in _wide(spark, data_dir, "_ts.parquet", files):
        df = wide_features(wide, jump_mm)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no series")
    return out


def classify(spark: SparkSession, data_dir: str, min_coherence: float = 0.5, min_velocity: float = 0.0, thresholds: rules.Thresholds = rules.Thresholds(), wanted: int = 5, seed: int = mixture.SEED) -> DataFrame:
    """Labels of all points, written to <data_dir>/labels. Metadata files without series are named and their points stay
    unclassified."""
    pairs, lonely = readers.pair_files(spark, data_dir)
    for f in lonely:
        print(f"no series for {f}: left out")
    if not pairs:
        raise ValueError("no pair of metadata and series")
    points = read_points(spark, data_dir)
    chosen = rules.eligible(points, min_coherence, min_velocity).select(*KEY)
    stage = Stage(spark, "classify")
    found = series_features(spark, data_dir, [ts for _, ts in pairs], thresholds.jump_mm)
    found = stage.keep(found.join(chosen, KEY, "left_semi"), "features")
    names = list(FEATURES)
    rest = found.where(rules.rule_class(thresholds).isNull()).select(*KEY)
    scaled = rules.robust_scale(found, names).join(rest, KEY, "left_semi")
    residual = stage.keep(mixture.classify_residual(scaled, names, wanted, seed=seed), "residual")
    labels = rules.classify(found, points, residual, thresholds)
    labels.write.mode("overwrite").parquet(f"{data_dir}/labels")
    return spark.read.parquet(f"{data_dir}/labels")


def _labelled(spark: SparkSession, data_dir: str) -> DataFrame:
    points = read_points(spark, data_dir)
    return points.drop("class_1").join(spark.read.parquet(f"{data_dir}/labels").select(*KEY, "class_1"), KEY, "left")


def cluster(spark: SparkSession, data_dir: str, min_velocity: float = 2.5, min_coherence: float = 0.5, exclude: Sequence[str] = ("unclassified", "stable", "noisy"), eps_m: float = 100, eps_vel: float = 3, min_samples: int = 5, buffer_m: float = 20, min_purity: float = 0.5, shapefile: bool = False) -> DataFrame:
    """Cluster ids of all points to <data_dir>/assignments, polygons in degrees to clusters_polygons (GeoParquet) and in metres to
    clusters_polygons.gpkg, their attributes to clusters_summary (CSV), and a shapefile in degrees if wanted. Returns the
    polygons in metres."""
    stage = Stage(spark, "cluster")
    use = clusters.load_eligible(_labelled(spark, data_dir), min_velocity, min_coherence, tuple(exclude))
    use = stage.keep(numbered(stage, use, *KEY, name="idx"), "eligible")
    members = stage.keep(use.join(dbscan(use, eps_m, eps_vel, min_samples), "idx"), "members")
    assigned = members.select(*KEY, cluster_id(F.col("label")).alias("cluster_id"))
    clusters.with_cluster_ids(read_points(spark, data_dir).select(*KEY), assigned).write.mode("overwrite").parquet(f"{data_dir}/assignments")
    shapes = clusters.summarise(members, min_purity).join(clusters.polygons(members, ["label"], buffer_m), "label").drop("label")
    shapes = stage.keep(shapes, "shapes")
    sinks.write_summary(shapes, f"{data_dir}/clusters_summary")
    degrees = stage.keep(shapes.withColumn("geometry", to_degrees("geometry")), "degrees")
    sinks.write_geo(degrees, f"{data_dir}/clusters_polygons")
    sinks.write_geopackage(shapes, f"{data_dir}/clusters_polygons.gpkg", "clusters")
    if shapefile:
        sinks.write_shapefile(degrees, f"{data_dir}/clusters_polygons")
    return shapes


def subcluster(spark: SparkSession, data_dir: str, classes: Sequence[str] = ("linear", "accel", "decel", "variable"), eps_m: float = 50, eps_vel: float = 2, min_samples: int = 3, buffer_m: float = 15) -> DataFrame:
    """Sub-cluster ids to <data_dir>/subassignments, polygons in degrees to subclusters_polygons (GeoParquet) and in metres to
    subclusters_polygons.gpkg. Returns the polygons in degrees."""
    stage = Stage(spark, "subcluster")
    points = _labelled(spark, data_dir).join(spark.read.parquet(f"{data_dir}/assignments"), KEY)
    use = points.where(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != schema.NOISE) & F.col("class_1").isin(list(classes)))
    use = use.select(*KEY, "cluster_id", "class_1", F.col("easting").cast("double").alias("e"), F.col("northing").cast("double").alias("n"), F.col("mean_velocity").cast("double").alias("v"))
    use = stage.keep(numbered(stage, use, *KEY, name="idx"), "eligible")
    found = dbscan(use, eps_m, eps_vel, min_samples, ("cluster_id", "class_1"), 0.01)
    members = stage.keep(use.join(found.select("idx", "label"), "idx").withColumn("subcluster_id", subcluster_id(F.col("cluster_id"), F.col("label"))), "members")
    clusters.with_subcluster_ids(read_points(spark, data_dir).select(*KEY), members).write.mode("overwrite").parquet(f"{data_dir}/subassignments")
    by = ["cluster_id", "class_1", "label"]
    stats = members.where("label >= 0").groupBy(*by, "subcluster_id").agg(F.count("*").alias("n_points"), F.round(F.avg("v"), 2).alias("mean_vel"))
    shapes = stats.join(clusters.polygons(members, by, buffer_m, 16), by)
    shapes = shapes.select("subcluster_id", F.col("cluster_id").alias("parent_id"), F.col("class_1").alias("ts_class"), "n_points", "mean_vel", "geometry")
    shapes = stage.keep(shapes, "shapes")
    sinks.write_geopackage(shapes, f"{data_dir}/subclusters_polygons.gpkg", "subclusters")
    sinks.write_geo(stage.keep(shapes.withColumn("geometry", to_degrees("geometry")), "degrees"), f"{data_dir}/subclusters_polygons")
    return spark.read.parquet(f"{data_dir}/subclusters_polygons")


def everything(spark: SparkSession, data_dir: str) -> DataFrame:
    """Points with the labels and ids that have been written."""
    out = read_points(spark, data_dir)
    for name in ("labels", "assignments", "subassignments"):
        if not readers.exists(spark, f"{data_dir}/{name}"):  # that step has not run
            continue
        extra = spark.read.parquet(f"{data_dir}/{name}")
        out = out.drop(*[c for c in extra.columns if c not in KEY]).join(extra, KEY, "left")
    return out
