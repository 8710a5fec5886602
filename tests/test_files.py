import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terradrift.functions.geometry import polygon_wkb
from terradrift.operators import ingest
from terradrift.sources import readers, sinks
from terradrift.streaming import incremental

HEADER = "pid,latitude,longitude,track_angle,temporal_coherence,mean_velocity,line,junk,20190111,D20190105\n"
ROWS = ["a,45.0,7.0,190,0.9,1.5,3,?,1.0,2.5\n", "b,46.0,8.0,10,0.2,x,3.5,?,,nan\n", "c,10.0,8.0,,0.8,-9,4,?,1_0,7\n"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.csv").write_text(HEADER + "".join(ROWS))
    return tmp_path


def test_csv_to_points_and_series(spark, folder):
    raw, bad = readers.read_deliveries(spark, str(folder))
    assert bad is None
    points, wide = ingest.convert(raw)
    got = {r["pid"]: r for r in points.collect()}
    assert [got[p]["orbit"] for p in "abc"] == ["D", "A", "U"]
    assert (got["a"]["max_gap_days"], got["a"]["n_acquisitions"], got["a"]["source_file"]) == (6, 2, "one.csv")
    assert got["b"]["mean_velocity"] is None and got["b"]["line"] is None and got["a"]["line"] == 3
    assert got["a"]["bbox"] == (7.0, 45.0, 7.0, 45.0) and len(got["a"]["geometry"]) == 21
    assert {r["pid"]: (r["20190105"], r["20190111"]) for r in wide.collect()} == {"a": (2.5, 1.0), "b": (None, None), "c": (7.0, None)}
    kept, series = ingest.convert(raw, min_coherence=0.5, velocity_limit=5, box=(6, 44, 9, 47))
    assert [r["pid"] for r in kept.collect()] == ["a"] == [r["pid"] for r in series.collect()]
    assert ingest.convert(raw, min_coherence=2)[0].count() == 0
    assert tuple(ingest.rejected(ingest.in_box(ingest.coerce(raw), (6, 44, 9, 47)), 0.5, 5).first()) == (1, 1)
    with pytest.raises(ValueError):
        ingest.in_box(points, (9, 44, 6, 47))


def test_headers():
    with pytest.raises(ValueError, match="date"):
        ingest.check_header(["pid", "track_angle", "latitude", "longitude"])
    with pytest.raises(ValueError, match="track_angle"):
        ingest.check_header(["pid", "latitude", "longitude", "20190101"])


def test_zip_only_without_csv(spark, folder, tmp_path_factory):
    only = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(only / "two.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("data.csv", HEADER + ROWS[0])
        z.writestr("later.csv", "never")
    (only / "bad.zip").write_bytes(b"not an archive")
    raw, bad = readers.read_deliveries(spark, str(only))
    assert [(r["source_file"], r["pid"]) for r in raw.collect()] == [("two.csv", "a")]
    assert [r["source_file"] for r in bad.collect()] == ["bad.csv"]


def test_parquet_by_name_pairs_and_footers(spark, tmp_path):
    points = spark.createDataFrame([("x.csv", "1", 1.5), ("y.csv", "2", 2.5)], "source_file string, pid string, v double")
    foot = {s: sinks.footer(["20190105", "20190111"], s, 1, 6) for s in ("x.csv", "y.csv")}
    written = sinks.write_files(points, str(tmp_path / "out"), "_meta.parquet", foot).collect()
    assert sorted((r["source_file"], r["n"]) for r in written) == [("x.csv", 1), ("y.csv", 1)]
    assert sinks.write_files(points.where("pid = '1'"), str(tmp_path / "out"), "_ts.parquet", {}).count() == 1
    import pyarrow.parquet as pq

    meta = pq.read_schema(tmp_path / "out" / "x_meta.parquet").metadata
    assert json.loads(meta[b"points_ts_dates"]) == ["20190105", "20190111"] and meta[b"points_n_points"] == b"1"
    sinks.with_footer(str(tmp_path / "out" / "x_meta.parquet"), {"more": "1"}, "zstd")
    again = pq.ParquetFile(tmp_path / "out" / "x_meta.parquet")
    assert again.schema_arrow.metadata[b"more"] == b"1" and again.metadata.row_group(0).column(0).compression == "ZSTD"
    pairs, lonely = readers.pair_files(spark, str(tmp_path / "out"))
    assert [p[0].rsplit("/", 1)[-1] for p in pairs] == ["x_meta.parquet"] and [p.rsplit("/", 1)[-1] for p in lonely] == ["y_meta.parquet"]
    spark.createDataFrame([("3", 7)], "pid string, v int").write.parquet(str(tmp_path / "out" / "z_meta.parquet"))
    both = readers.read_parquet_by_name(spark, str(tmp_path / "out"), "_meta.parquet")
    assert sorted((r["pid"], r["v"]) for r in both.collect()) == [("1", 1.5), ("2", 2.5)]
    assert readers.point_files(["/a/x_meta.parquet", "/a/clusters_polygons.parquet", "/a/subclusters.parquet"]) == ["/a/x_meta.parquet"]


def test_checked_write_summary_manifest_and_geopackage(spark, tmp_path):
    ring = np.array([(0, 0), (10, 0), (0, 10)], float)
    shapes = spark.createDataFrame([("CL_0000", 3, bytearray(polygon_wkb(ring))), ("CL_0001", 1, None)], "cluster_id string, n_points long, geometry binary")
    assert sinks.write_checked(shapes, str(tmp_path / "p")) == 2
    sinks.write_summary(shapes, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["cluster_id", "n_points"]
    sinks.write_manifest(str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    assert sinks.write_geopackage(shapes, str(tmp_path / "c.gpkg"), "clusters") == 2
    layer, epsg = readers.read_geopackage(spark, str(tmp_path / "c.gpkg"), "clusters")
    back = {r["cluster_id"]: r for r in layer.collect()}
    assert bytes(back["CL_0000"]["geometry"]) == polygon_wkb(ring) and back["CL_0001"]["geometry"] is None and epsg == 3035
    assert layer.dtypes == [("fid", "bigint"), ("geometry", "binary"), ("cluster_id", "string"), ("n_points", "bigint")]


def test_geoparquet_folders(spark, tmp_path):
    """Each file names its geometry column, its system and its bounds; a failed count takes the folder away."""
    import pyarrow.parquet as pq

    ring = np.array([(7, 45), (8, 45), (7, 46)], float)
    shapes = spark.createDataFrame([(f"CL_{k:04d}", bytearray(polygon_wkb(ring + k))) for k in range(6)], "cluster_id string, geometry binary").repartition(3)
    assert sinks.write_geo(shapes, str(tmp_path / "polys")) == 6
    bounds = []
    for f in (tmp_path / "polys").glob("*.parquet"):
        geo = json.loads(pq.read_schema(f).metadata[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert geo["version"] == "1.1.0" and column["encoding"] == "WKB" and column["geometry_types"] == ["Polygon"] and "crs" not in column
        bounds.append(column["bbox"])
    assert len(bounds) > 1 and [min(b[0] for b in bounds), max(b[3] for b in bounds)] == [7.0, 51.0]
    assert not list((tmp_path / "polys").glob(".part*"))
    assert sinks.write_geo(shapes, str(tmp_path / "polys"), epsg=3035) == 6  # in place of the others
    moved = readers.read_polygons(spark, str(tmp_path), "polys")
    assert moved.count() == 6 and bytes(moved.first()["geometry"]) != bytes(shapes.first()["geometry"])
    assert sinks.write_geo(shapes.limit(0), str(tmp_path / "none")) == 0 and spark.read.parquet(str(tmp_path / "none")).columns == shapes.columns
    sinks.write_geo(shapes, str(tmp_path / "odd"), epsg=32632)
    with pytest.raises(ValueError, match="32632"):
        readers.read_polygons(spark, str(tmp_path), "odd")
    assert readers.read_polygons(spark, str(tmp_path), "missing") is None


def test_shapefile(spark, tmp_path):
    import struct

    ring = np.array([(7, 45), (8, 45), (7, 46)], float)
    shapes = spark.createDataFrame([("CL_0000", 3, 1.25, True, bytearray(polygon_wkb(ring))), ("CL_0001", None, None, None, None)], "cluster_id string, n_points long, velocity_mean_mm double, is_mixed boolean, geometry binary")
    assert sinks.write_shapefile(shapes, str(tmp_path / "c")) == 2
    shp, shx, dbf = ((tmp_path / f"c.{e}").read_bytes() for e in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[:4]) == (9994,) and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx) == 116
    at, size = struct.unpack(">ii", shx[100:108])
    kind, *box = struct.unpack("<i4d", shp[2 * at + 8 : 2 * at + 44])
    assert (kind, box) == (5, [7.0, 45.0, 8.0, 46.0]) and size * 2 == 4 + 32 + 12 + 4 * 16
    points = np.frombuffer(shp[2 * at + 56 : 2 * at + 120], "<f8").reshape(4, 2)
    x, y = points.T
    assert (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0 and {tuple(p) for p in points.tolist()} == {tuple(p) for p in ring.tolist()}
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    names = [dbf[k : k + 11].split(b"\0")[0].decode() for k in range(32, head - 1, 32)]
    assert (n, names) == (2, ["cluster_id", "n_points", "velocity_m", "is_mixed"])
    row = dbf[head : head + width].decode()
    assert row[1:255].strip() == "CL_0000" and row.split()[1:] == ["3", "1.250000000T"] and dbf[head + width : head + 2 * width].decode().rstrip().endswith("?")
    assert "WGS_1984" in (tmp_path / "c.prj").read_text()


def test_parts_of_large_sources_and_unknown_stores(spark, tmp_path, monkeypatch):
    points = spark.range(500).selectExpr("'x.csv' as source_file", "string(id) as pid", "45.0D + id / 1000 as latitude", "7.0D as longitude").unionByName(spark.createDataFrame([("y.csv", "1", 45.0, 7.0)], "source_file string, pid string, latitude double, longitude double"))
    done = sinks.write_files(points, str(tmp_path / "out"), "_meta.parquet", {}, parts={"x.csv": 4}).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in done) == [*(f"x.part{k:04d}_meta.parquet" for k in range(4)), "y_meta.parquet"]
    assert sum(r["n"] for r in done) == 501 and all(0 < r["n"] < 200 for r in done)
    monkeypatch.chdir(tmp_path)
    with pytest.raises(Exception, match="(?i)scheme|filesystem|unrecognized"):
        sinks.write_files(points, "nosuch://bucket/out", "_meta.parquet", {}).collect()
    assert not list(tmp_path.glob("nosuch*"))


def test_a_failed_attempt_takes_its_files_away(spark, tmp_path):
    from pyspark.sql import types as T

    fail = F.udf(lambda i: 1 // (i - 150), T.LongType())
    rows = spark.range(200, numPartitions=1).select(F.lit("x.csv").alias("source_file"), F.col("id").cast("string").alias("pid"), fail("id").alias("v"))
    with pytest.raises(Exception):
        sinks.write_files(rows, str(tmp_path / "out"), "_meta.parquet", {}).collect()
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_pruned_scan(spark, tmp_path):
    from terradrift.operators.views import points_in_view

    rows = spark.range(2000).select(F.col("id").cast("string").alias("pid"), (40 + F.col("id") / 200).alias("latitude"), F.lit(7.0).alias("longitude"), F.lit(0.9).alias("temporal_coherence"), F.lit(5.0).alias("mean_velocity"), F.lit("A").alias("orbit"))
    sinks.write_points(rows, str(tmp_path / "points"))
    view = points_in_view(spark.read.parquet(str(tmp_path / "points")), min_lat=41, max_lat=42, zoom=15)
    plan = view._jdf.queryExecution().explainString(view._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(latitude,41" in plan.replace("...", "") and view.count() == 201
    assert points_in_view(rows, max_pts=7, zoom=15).count() == 7


def test_incremental_ingest_and_stream(spark, folder, tmp_path):
    out = tmp_path / "done"
    assert [p.rsplit("/", 1)[-1] for p in incremental.pending(spark, str(folder), str(out))] == ["one.csv"]
    out.mkdir()
    for s in ("meta", "ts"):
        spark.range(1).write.parquet(str(out / f"one_{s}.parquet" / "x"))
    names = HEADER.strip().split(",")
    schema = ", ".join(f"`{n}` string" for n in names)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text(HEADER + ROWS[0])
    run = lambda: incremental.ingest_stream(spark, str(source), schema, str(tmp_path / "sink"), str(tmp_path / "cp"), ingest.coerce).awaitTermination(120)
    run()
    (source / "b.csv").write_text(HEADER + ROWS[1])
    run()
    got = spark.read.parquet(str(tmp_path / "sink"))
    assert sorted(r["pid"] for r in got.collect()) == ["a", "b"]


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 05:00:00' + make_interval(0,0,0,0,id) as ts, 'k' as event_type, 1.0D as value from range(72)")
    rows.write.parquet(str(tmp_path / "e"))
    stream = incremental.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), by=("event_type",))
    q = stream.writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("windows_out").collect()) == [5, 19, 24, 24]
