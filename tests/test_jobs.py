import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from terradrift import cli, jobs
from terradrift.sources.sinks import bounds_of, geo_epsg

DATES = [f"2019{m:02d}{d:02d}" for m in range(1, 13) for d in (5, 15, 25)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Two deliveries with different dates: two groups of moving points, and stable ones far away."""
    rng = np.random.default_rng(0)
    raw, out = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    for f, dates in (("one.csv", DATES), ("two.csv", DATES[2:])):
        t = np.arange(len(dates)) / 36
        lines = ["pid,latitude,longitude,easting,northing,track_angle,temporal_coherence,mean_velocity," + ",".join(f"D{d}" for d in dates)]
        for k in range(40):
            v = (-12.0, 9.0, 0.1, 0.0)[k % 4]
            e, n = (4321000 + 5000 * (k % 4) + k, 3210000 + 2 * k)
            y = v * t + rng.normal(0, 0.1, len(dates))
            lines.append(f"{f[0]}{k},{45 + k / 1000},{7 + k / 1000},{e},{n},{190 if k % 2 else 10},0.{5 + k % 5},{v}," + ",".join(f"{x:.3f}" for x in y))
        (raw / f).write_text("\n".join(lines) + "\n")
    return raw, out


def test_whole_path(spark, data):
    raw, out = map(str, data)
    done = {r["source_file"]: r for r in jobs.convert(spark, raw, out).collect()}
    assert {k: (r["status"], r["n_points"]) for k, r in done.items()} == {"one.csv": ("ok", 40), "two.csv": ("ok", 40)}
    assert all(r["in_bytes"] > 1000 and r["out_bytes"] > 1000 for r in done.values())
    again = jobs.convert(spark, raw, out)
    assert {r["source_file"]: r["status"] for r in again.collect()} == {"one.csv": "skipped", "two.csv": "skipped"}
    assert jobs.batch_totals(again).first()["n_skipped"] == 2
    labels = {r["pid"]: r["class_1"] for r in jobs.classify(spark, out, 0.6).collect()}
    assert len(labels) == 80 and labels["o0"] == "unclassified" and labels["o4"] == "linear" and labels["t2"] == "stable"
    shapes = jobs.cluster(spark, out, min_coherence=0.6).collect()
    assert [s["dom_class"] for s in shapes] == ["linear", "linear"] and {s["vel_mean"] for s in shapes} == {-12.0, 9.0}
    assert {p.name for p in data[1].glob("clusters*")} == {"clusters_polygons", "clusters_polygons.gpkg", "clusters_summary"}
    subs = jobs.subcluster(spark, out).collect()
    from terradrift.sources.readers import read_polygons

    west = [bounds_of([bytes(r["geometry"])])[0] for name in ("clusters_polygons", "subclusters_polygons") for r in read_polygons(spark, out, name).collect()]
    assert all(9.9 < x < 10.2 for x in west)  # degrees near the origin of the projection, from either format
    assert {s["parent_id"] for s in subs} == {"CL_0000", "CL_0001"} and sum(s["n_points"] for s in subs) == sum(s["n_points"] for s in shapes)
    every = jobs.everything(spark, out)
    assert every.count() == 80 and every.where("cluster_id = 'NOISE'").count() == 80 - sum(s["n_points"] for s in shapes)
    gaps = {r["source_file"]: r["n_acquisitions"] for r in every.select("source_file", "n_acquisitions").distinct().collect()}
    assert gaps == {"one": 36, "two": 34}


def test_endpoints(spark, data):
    server = cli.serve(cli.Viewer(spark, str(data[1])), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/get_points?zoom=15&thresh=5&desc=false", timeout=120) as r:
        assert int(r.headers["X-Rendered-Count"]) == len(json.loads(r.read())) and int(r.headers["X-Total-Count"]) > 0
    status, rows = get("/get_points?zoom=15&thresh=5&desc=false")
    assert status == 200 and rows and {r["orbit"] for r in rows} == {"A"} and rows[0]["total_count"] == 2 * len(rows)  # the files share their places
    assert get("/get_points?asc=false&desc=false") == (200, [])
    status, one = get("/get_timeseries?pid=t4")
    assert status == 200 and len(one["dates"]) == len(one["values"]) == 34 and one["cluster_id"].startswith("CL_")
    assert get("/get_timeseries")[0] == 400 and get("/get_timeseries?pid=nobody")[0] == 404
    info = get("/get_info")[1]
    assert info["total_points"] == 80 and info["date_range"]["n_dates"] == 36 and info["has_clusters"]
    shapes = get("/get_clusters")[1]
    boxes = [f["bbox"] for f in shapes["features"]]
    assert len(boxes) == 2 and shapes["bbox"] == [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
    assert get("/get_subclusters")[1]["type"] == "FeatureCollection"
    assert get("/health")[1] == {"status": "ok", "points": 80} and get("/nothing")[0] == 404
    server.shutdown()


def test_arguments():
    a = cli.parser().parse_args(["cluster", "--data-dir", "x", "--exclude-classes", "noisy"])
    assert (a.eps_m, a.exclude_classes, a.min_samples) == (100.0, ["noisy"], 5)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["convert"])


def test_convert_reports_and_verifies(spark, tmp_path, monkeypatch, capsys):
    """A file with a bad header fails alone; a pair whose series are gone is found, and classify names it."""
    import pyarrow.parquet as pq

    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    dates = ",".join(f"D{d}" for d in DATES)
    head = f"pid,latitude,longitude,easting,northing,track_angle,temporal_coherence,mean_velocity,{dates}\n"
    row = lambda k: f"p{k},45.{k:03d},7.0,4321000,3210000,10,0.9,5.0," + ",".join(str(0.1 * k * i) for i in range(36)) + "\n"
    (raw / "good.csv").write_text(head + "".join(row(k) for k in range(60)))
    (raw / "other.csv").write_text(head + "".join(row(k) for k in range(100, 130)))
    (raw / "bad.csv").write_text("pid,latitude\n1,2\n")
    monkeypatch.setattr(jobs, "FILE_POINTS", 25)
    done = {r["source_file"]: r for r in jobs.convert(spark, str(raw), str(out)).collect()}
    assert {k: (r["status"], r["n_points"]) for k, r in done.items()} == {"good.csv": ("ok", 60), "other.csv": ("ok", 30), "bad.csv": ("error", None)}
    assert "missing columns" in done["bad.csv"]["message"]
    files = sorted(p.name for p in out.glob("*.parquet"))
    assert [f for f in files if f.startswith("good")] == [f"good.part{k:04d}_{s}.parquet" for k in range(3) for s in ("meta", "ts")]
    geo = pq.read_schema(out / "good.part0000_meta.parquet").metadata
    assert geo_epsg(geo) == 4326 and json.loads(geo[b"geo"])["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    assert json.loads(geo[b"points_ts_dates"])[0] == DATES[0]
    assert jobs.read_points(spark, str(out)).groupBy("source_file").count().collect().__len__() == 2
    assert {r["status"] for r in jobs.convert(spark, str(raw), str(out)).collect()} == {"skipped", "error"}
    (out / "other.part0000_ts.parquet").unlink()
    wrong = jobs.verify_pairs(spark, str(out), {"good.csv": 60, "other.csv": 30})
    assert set(wrong) == {"other.csv"} and "without series" in wrong["other.csv"]
    labels = jobs.classify(spark, str(out), 0.5)
    assert "other.part0000_meta.parquet" in capsys.readouterr().out
    gone = labels.where("source_file = 'other' and class_1 = 'unclassified'").count()
    assert 0 < gone < 30 and labels.where("source_file = 'good' and class_1 = 'unclassified'").count() == 0


def test_series_are_not_shuffled_before_the_kernel(spark, data):
    plan = jobs.series_features(spark, str(data[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
