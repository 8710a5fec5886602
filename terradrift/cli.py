"""Commands: convert, classify, cluster, subcluster, serve."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from terradrift import jobs, schema
from terradrift.functions.geometry import collection
from terradrift.operators import views
from terradrift.operators.classify import Thresholds
from terradrift.session import session
from terradrift.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terradrift")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        p = commands.add_parser(name)
        for flag, kind, default in options:
            if kind is bool:
                p.add_argument(flag, action="store_true")
            elif isinstance(kind, list):
                p.add_argument(flag, nargs="+", type=kind[0], default=default)
            else:
                p.add_argument(flag, type=kind, default=default, required=default is ...)

    data = ("--data-dir", str, ...)
    command("convert", ("--input-dir", str, ...), ("--out-dir", str, ...), ("--compression", str, "snappy"), ("--min-coherence", float, None), ("--abs-velocity-limit", float, None), ("--bbox", [float], None), ("--force", bool, False), ("--no-verify", bool, False))
    command("classify", data, ("--min-coh", float, 0.5), ("--min-vel", float, 0.0), ("--v-stable", float, 2.5), ("--noise-thresh", float, 3.0), ("--quad-r2", float, 0.05), ("--accel-thresh", float, 1.5), ("--cusum-thresh", float, 2.5), ("--jump-mm", float, 5.0), ("--seasonal-r2", float, 0.15), ("--noisy-trend", float, 4.0), ("--n-components", int, 5), ("--random-state", int, 42))
    command("cluster", data, ("--min-vel", float, 2.5), ("--min-coh", float, 0.5), ("--exclude-classes", [str], ["unclassified", "stable", "noisy"]), ("--eps-m", float, 100.0), ("--eps-vel", float, 3.0), ("--min-samples", int, 5), ("--buffer-m", float, 20.0), ("--min-purity", float, 0.5), ("--shapefile", bool, False))
    command("subcluster", data, ("--eps-m", float, 50.0), ("--eps-vel", float, 2.0), ("--min-samples", int, 3), ("--buffer-m", float, 15.0), ("--active-classes", [str], ["linear", "accel", "decel", "variable"]))
    command("serve", data, ("--port", int, 5000), ("--host", str, "127.0.0.1"))
    return top


class Viewer:
    """Answers of the viewer's endpoints as (status, JSON text)."""

    def __init__(self, spark, data_dir: str):
        self.spark, self.data_dir = spark, data_dir
        self.points = jobs.everything(spark, data_dir)
        self.series = jobs.read_series(spark, data_dir)
        corrected = readers.list_files(spark, data_dir, "_ts_corrected.parquet", recursive=True)
        self.corrected = jobs.read_series(spark, data_dir, "_ts_corrected.parquet") if corrected else None

    def answer(self, path: str, q: dict[str, str]) -> tuple[int, str]:
        return self.reply(path, q)[:2]

    def reply(self, path: str, q: dict[str, str]) -> tuple[int, str, dict[str, str]]:
        """Status, body and the headers beside the usual ones."""
        status, body = self._found(path, q)
        counts = {}
        if path == "/get_points" and status == 200:
            rows = json.loads(body)
            counts = {"X-Total-Count": str(rows[0]["total_count"] if rows else 0), "X-Rendered-Count": str(len(rows))}
        return status, body, counts

    def _found(self, path: str, q: dict[str, str]) -> tuple[int, str]:
        number = lambda name, default: float(q.get(name, default))
        yes = lambda name, default: q.get(name, default).lower() == "true"
        if path == "/get_points":
            rows = views.points_in_view(self.points, number("min_lat", -90), number("max_lat", 90), number("min_lon", -180), number("max_lon", 180), number("thresh", 2.5), number("min_coh", 0), yes("asc", "true"), yes("desc", "true"), int(number("zoom", 14)), int(number("max_pts", views.MAX_POINTS)))
            return 200, "[" + ",".join(rows.toJSON().toLocalIterator()) + "]"  # max_pts rows at most
        if path == "/get_timeseries":
            pid = q.get("pid", "")
            if not pid:
                return 400, json.dumps({"error": "pid is missing"})
            corrected = self.corrected if yes("corrected", "false") else None
            row = views.point_series(self.points, self.series, pid, corrected).drop("geometry").toJSON().take(1)
            return (200, row[0]) if row else (404, json.dumps({"error": "unknown pid"}))
        if path == "/get_info":
            info = json.loads(views.dataset_info(self.points).toJSON().first())
            dates = self.series.selectExpr("min(acq_date)", "max(acq_date)", "count(distinct acq_date)").first()
            info["date_range"] = {"start": str(dates[0]), "end": str(dates[1]), "n_dates": dates[2]}
            has = set(self.points.columns)
            return 200, json.dumps(info | {"has_classes": "class_1" in has, "class_colors": schema.COLORS if "class_1" in has else {}, "has_clusters": "cluster_id" in has, "has_subclusters": "subcluster_id" in has, "has_corrected": self.corrected is not None})
        if path in ("/get_clusters", "/get_subclusters"):
            name = "clusters_polygons" if path == "/get_clusters" else "subclusters_polygons"
            shapes = readers.read_polygons(self.spark, self.data_dir, name)
            if shapes is None:
                return 404, json.dumps({"error": f"no {name}"})
            return 200, collection([r["feature"] for r in views.geojson(shapes).toLocalIterator()])
        if path == "/health":
            return 200, views.health(self.points).toJSON().first()
        return 404, json.dumps({"error": "no such path"})


def serve(viewer: Viewer, host: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            try:
                status, body, more = viewer.reply(url.path, {k: v[0] for k, v in parse_qs(url.query).items()})
            except Exception as e:
                status, body, more = 500, json.dumps({"error": str(e)[:500]}), {}
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            for name, value in more.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "convert":
        report = jobs.convert(spark, a.input_dir, a.out_dir, a.compression, a.min_coherence, a.abs_velocity_limit, a.bbox and tuple(a.bbox), a.force, not a.no_verify)
        report.show(100_000, False)
        jobs.batch_totals(report).show(truncate=False)
        if report.where("status = 'error'").count():
            raise SystemExit(1)
    elif a.command == "classify":
        t = Thresholds(a.v_stable, a.noise_thresh, a.quad_r2, a.accel_thresh, a.cusum_thresh, a.jump_mm, a.seasonal_r2, a.noisy_trend)
        from terradrift.operators.classify import class_distribution, flag_distribution

        labels = jobs.classify(spark, a.data_dir, a.min_coh, a.min_vel, t, a.n_components, a.random_state)
        class_distribution(labels).show()
        flag_distribution(labels).show()
    elif a.command == "cluster":
        jobs.cluster(spark, a.data_dir, a.min_vel, a.min_coh, a.exclude_classes, a.eps_m, a.eps_vel, a.min_samples, a.buffer_m, a.min_purity, a.shapefile).drop("geometry").show()
    elif a.command == "subcluster":
        jobs.subcluster(spark, a.data_dir, a.active_classes, a.eps_m, a.eps_vel, a.min_samples, a.buffer_m).drop("geometry").show()
    else:
        serve(Viewer(spark, a.data_dir), a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
