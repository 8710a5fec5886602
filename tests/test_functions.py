import numpy as np
import pytest
from pyspark.sql import functions as F

from terradrift.functions import geometry as G
from terradrift.functions import scalars as S


def test_orbit_table(spark):
    angles = [0.0, 90.0, 90.5, 180.0, 269.5, 270.0, -10.0, -170.0, 540.0, 730.0, None, float("nan")]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(angles)], "i int, a double")
    assert "".join(r[0] for r in rows.orderBy("i").select(S.orbit(F.col("a"))).collect()) == "AADDDAADDAUU"


def test_numbers(spark):
    texts = ["1.5", " 2 ", "1.5d", "1_000", "", None, "x", "-3e2", ".5", "NaN", "7.0", "7.5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(S.number(F.col("t"), "double").alias("d"), S.number(F.col("t"), "int").alias("i")).collect()
    assert [r["d"] for r in got] == [1.5, 2.0, None, None, None, None, None, -300.0, 0.5, None, 7.0, 7.5]
    assert [r["i"] for r in got] == [None, 2, None, None, None, None, None, -300, None, None, 7, None]


def test_names():
    assert S.bare_date("D20190105") == S.bare_date("20190105") == "20190105" and S.bare_date("D2019010") is None
    assert list(S.short_names(["cluster_id", "class_purity", "class_purity_b", "geo"]).values()) == ["cluster_id", "class_puri", "class_pu01", "geo"]


def test_text_formats(spark):
    r = spark.range(1).select(
        S.cluster_id(F.lit(42)).alias("a"),
        S.cluster_id(F.lit(-1)).alias("b"),
        S.subcluster_id(F.lit("CL_0001"), F.lit(3)).alias("c"),
        S.subcluster_id(F.lit("CL_0001"), F.lit(-1)).alias("d"),
        S.class_color(F.lit("accel")).alias("e"),
        S.class_color(F.lit("?")).alias("f"),
        S.safe_pid(F.lit("a-b_c;'é1")).alias("g"),
        S.box_name(F.lit(-7.0), F.lit(44.0), F.lit(9.25), F.lit(45.5)).alias("h"),
        S.decimal_year(F.lit("2020-07-01").cast("date")).alias("y"),
    ).first()
    assert r[:8] == ("CL_0042", "NOISE", "CL_0001_SUB_003", "CL_0001_SUB_NOISE", "#e74c3c", "#cccccc", "a-b_cé1", "bbox_44.00N_45.50N_7.00W_9.25E")
    assert abs(r["y"] - (2020 + 182 / 366)) < 1e-12


def test_projection_round_trip_and_known_point():
    # the projection's origin, and a point computed with an independent library
    assert np.allclose(G.to_laea(10.0, 52.0), (4321000, 3210000))
    assert np.allclose(G.to_laea(5.0, 50.0), (3962799.45, 2999718.85), atol=0.02)
    lon, lat = np.meshgrid(np.linspace(-10, 30, 9), np.linspace(35, 70, 8))
    back = G.from_laea(*G.to_laea(lon.ravel(), lat.ravel()))
    assert np.allclose(back[0], lon.ravel(), atol=1e-9) and np.allclose(back[1], lat.ravel(), atol=1e-9)


@pytest.mark.parametrize("points, corners", [([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)], 4), ([(0, 0), (1, 1), (2, 2)], 2), ([(3, 3)], 1), ([(3, 3), (3, 3), (3, 3)], 1)])
def test_hull(points, corners):
    assert len(G.convex_hull(np.array(points, float))) == corners


def test_buffer_areas():
    square = np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float)
    area, x, y = G.area_centroid(G.hull_ring(square, 20))
    assert abs(area - (10000 + 400 * 20 + np.pi * 400)) < 0.002 * np.pi * 400 and np.allclose((x, y), (50, 50))
    assert abs(G.area_centroid(G.hull_ring(np.array([(5.0, 5.0)]), 0))[0] - np.pi) < 0.01
    assert abs(G.area_centroid(G.hull_ring(np.array([(0.0, 0.0), (10.0, 0.0)]), 0))[0] - (20 + np.pi)) < 0.01
    assert G.hull_ring(np.empty((0, 2)), 5) is None
    ring = G.hull_ring(square, 20)
    assert np.allclose(G.read_polygon(G.polygon_wkb(ring))[:-1], ring)


def test_point_geometry_and_geojson(spark):
    import json
    import struct

    rows = spark.createDataFrame([(7.5, 45.25), (None, 1.0)], "x double, y double")
    a, b = [r[0] for r in rows.select(G.point_wkb(F.col("x"), F.col("y"))).collect()]
    assert struct.unpack("<BIdd", a) == (1, 1, 7.5, 45.25) and b is None
    wkb = bytearray(G.polygon_wkb(np.array([(4321000.0, 3210000.0), (4321100.0, 3210000.0), (4321000.0, 3210100.0)])))
    shape = spark.createDataFrame([("a", None, wkb)], "name string, nothing string, geometry binary").withColumn("geometry", G.to_degrees("geometry"))
    feature = json.loads(G.feature_rows(shape).first()[0])
    assert feature["properties"] == {"name": "a"} and len(feature["geometry"]["coordinates"][0]) == 4
    assert np.allclose(feature["geometry"]["coordinates"][0][0], (10, 52))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from terradrift.tables import shared_folder

    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    for master, fails in (("local[4]", False), ("spark://host:7077", True), ("local-cluster[2,1,1024]", True)):
        fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                shared_folder(fake)
        else:
            assert shared_folder(fake).startswith("file:///")
