"""Sinks: Parquet pairs with footers, GeoParquet, GeoPackage, shapefiles, CSV, JSON manifests.

Files that Spark's own writers can't make (those with footers) are written by the tasks through a file system that is
looked up by the folder's scheme, under a name of the attempt, and renamed when they are complete; an attempt that fails
takes its files away."""

from __future__ import annotations

import contextlib
import json
import sqlite3
import struct
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradrift.functions.geometry import read_polygon
from terradrift.functions.scalars import short_names
from terradrift.ship import ship
from terradrift.tables import delete


def write_points(points: DataFrame, path: str, compression: str = "snappy") -> None:
    """Sorted by grid cell within files, so latitude and longitude statistics prune viewport scans."""
    cell = [F.floor(F.col("latitude") * 10), F.floor(F.col("longitude") * 10)]
    points.repartitionByRange(*cell).sortWithinPartitions(*cell).write.mode("overwrite").option("compression", compression).parquet(path)


def write_checked(df: DataFrame, path: str, compression: str = "snappy") -> int:
    """Writes and counts what was written; raises where rows are missing."""
    expected = df.count()
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise OSError(f"{path}: {found} rows written of {expected}")
    return found


def geo_metadata(bounds: list[float], kind: str = "Polygon", epsg: int = 4326, covering: str | None = None) -> dict:
    """GeoParquet 1.1 metadata of a geometry column. covering: a struct column with each row's bounds."""
    column = {"encoding": "WKB", "geometry_types": [kind], "bbox": bounds}
    if epsg != 4326:  # longitude and latitude are what a missing crs means
        column["crs"] = {"$schema": "https://proj.org/schemas/v0.5/projjson.schema.json", "type": "ProjectedCRS", "name": f"EPSG:{epsg}", "id": {"authority": "EPSG", "code": epsg}}
    if covering:
        column["covering"] = {"bbox": {k: [covering, k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}


def geo_epsg(metadata: dict | None) -> int | None:
    """EPSG code of a file's geometry column, from its key-value pairs; 4326 where no system is named, None where it isn't a
    GeoParquet file."""
    if not metadata or b"geo" not in metadata:
        return None
    geo = json.loads(metadata[b"geo"])
    crs = geo["columns"][geo["primary_column"]].get("crs")
    return int(crs["id"]["code"]) if crs else 4326


def bounds_of(wkb: list[bytes | None]) -> list[float] | None:
    """West, south, east and north of little-endian points and polygons."""
    boxes = []
    for g in wkb:
        if g is not None:
            xy = np.frombuffer(g[5:21], "<f8")[None] if g[1] == 1 else read_polygon(g)
            boxes.append([*xy.min(0), *xy.max(0)])
    if not boxes:
        return None
    b = np.array(boxes)
    return [float(v) for v in (*b[:, :2].min(0), *b[:, 2:].max(0))]


def store(folder: str):
    """File system and path of a folder: the machine's own for file: and plain paths, which executors must share, and
    what pyarrow knows for other schemes; an unknown one is an error."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


class PartWriter:
    """One Parquet file, whose key-value pairs may be added at the end."""

    def __init__(self, folder: str, name: str, attempt: int, schema, compression: str):
        import pyarrow.parquet as pq

        self.fs, root = store(folder)
        self.path = f"{root.rstrip('/')}/{name}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.tmp, self.n, self.schema = f"{root.rstrip('/')}/.{name}.{attempt}", 0, schema  # readers pass over dotted names
        # without the Arrow schema, so that its readers take the pairs added at the end for the schema's too
        self.out = pq.ParquetWriter(self.tmp, schema, compression=compression, filesystem=self.fs, store_schema=False)

    def write(self, table) -> None:
        self.out.write_table(table.replace_schema_metadata(self.schema.metadata), row_group_size=50_000)
        self.n += len(table)

    def close(self, extra: dict[str, str] | None = None) -> None:
        pairs = {k.decode(): v.decode() for k, v in (self.schema.metadata or {}).items()} | (extra or {})
        if pairs:
            self.out.add_key_value_metadata(pairs)
        self.out.close()
        self.fs.move(self.tmp, self.path)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # what is wrong has been raised already
            self.out.close()
        with contextlib.suppress(Exception):
            self.fs.delete_file(self.tmp)


def write_geo(df: DataFrame, folder: str, kind: str = "Polygon", epsg: int = 4326, compression: str = "snappy") -> int:
    """A folder of GeoParquet files, a part each, in place of what is there; raises where rows are missing."""
    ship(df.sparkSession)
    expected, spark = df.count(), df.sparkSession
    delete(spark, folder)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, out, boxes = TaskContext.get(), None, []
        try:
            for batch in batches:
                out = out or PartWriter(folder, f"part-{context.partitionId():05d}.parquet", context.taskAttemptId(), batch.schema, compression)
                out.write(pa.Table.from_batches([batch]))
                boxes.append(bounds_of(batch["geometry"].to_pylist()))
            if out:
                boxes = np.array([b for b in boxes if b] or [[0.0] * 4])
                bounds = [float(v) for v in (*boxes[:, :2].min(0), *boxes[:, 2:].max(0))]
                out.close({"geo": json.dumps(geo_metadata(bounds, kind, epsg))})
                yield pa.RecordBatch.from_pydict({"n": [out.n]})
        except BaseException:
            if out:
                out.drop()
            raise

    if not expected:  # a folder with one file of no rows still has its columns
        df.limit(0).coalesce(1).write.mode("overwrite").parquet(folder)
        return 0
    written = df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    found = spark.read.parquet(folder).count()
    if not written == found == expected:
        delete(spark, folder)
        raise OSError(f"{folder}: {found} rows written of {expected}")
    return found


def footer(dates: list[str], source: str, n_points: int, max_gap: int, min_coherence=None, velocity_limit=None, prefix: str = "points_") -> dict[str, str]:
    """Key-value pairs of a metadata file."""
    values = {
        "source_file": source,
        "ts_start": dates[0],
        "ts_end": dates[-1],
        "ts_n_dates": len(dates),
        "ts_max_gap_days": max_gap,
        "n_points": n_points,
        "min_coherence": min_coherence,
        "abs_velocity_limit": velocity_limit,
        "orbit_encoding": "A=Ascending D=Descending U=Unknown",
        "ts_dates": json.dumps(dates),
    }
    return {prefix + k: str(v) for k, v in values.items()}


def with_footer(path: str, extra: dict[str, str], compression: str = "snappy", row_group: int | None = None) -> None:
    """Adds key-value pairs to a Parquet file, row group by row group, into a new file that then replaces it; what the file
    has already stays."""
    import pyarrow.parquet as pq

    folder, name = path.rsplit("/", 1)
    files, at = store(path)
    with files.open_input_file(at) as data:
        source = pq.ParquetFile(data)
        schema = source.schema_arrow
        schema = schema.with_metadata((schema.metadata or {}) | {k.encode(): v.encode() for k, v in extra.items()})
        out = PartWriter(folder, name, 0, schema, compression)
        try:
            for batch in source.iter_batches(batch_size=row_group or 50_000):
                out.out.write_batch(batch.cast(schema) if batch.schema != schema else batch)
            out.close()
        except BaseException:
            out.drop()
            raise


def write_files(df: DataFrame, folder: str, suffix: str, footers: dict[str, dict[str, str]], compression: str = "snappy", parts: dict[str, int] | None = None, geometry: str | None = None) -> DataFrame:
    """One Parquet file per source_file in a folder that executors share, with the footer of that source; of sources with
    several parts, one file a part (<stem>.part0001<suffix> and so on, by a hash of pid), so that no task writes a whole
    large delivery. geometry: what kind a geometry column holds, which makes a GeoParquet file. Rows
    of a file stream through its task in row groups of 50,000. Returns source_file, path, n."""
    spark = df.sparkSession
    ship(spark)
    names = [c for c in df.columns if c != "source_file"]
    covering = "bbox" if "bbox" in names else None
    counts = spark.createDataFrame(sorted((parts or {}).items()), "source_file string, parts int")  # a row a file
    dealt = df.join(F.broadcast(counts), "source_file", "left").withColumn("part", F.pmod(F.xxhash64("pid"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = dealt.repartition("source_file", "part").sortWithinPartitions("source_file", "part", *(["latitude", "longitude"] if geometry else [])).select("source_file", "part", *names)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        open_: dict[tuple, PartWriter] = {}
        boxes: dict[tuple, list] = {}
        done = []
        try:
            for batch in batches:
                keys = list(zip(batch["source_file"].to_pylist(), batch["part"].to_pylist(), strict=True))
                for key in [k for k in open_ if k != keys[-1] and k not in keys]:  # rows are sorted by file
                    done.append(finish(key, open_.pop(key), boxes.get(key, [])))
                for key in dict.fromkeys(keys):
                    rows = pa.Table.from_batches([batch]).filter(pa.array([k == key for k in keys])).select(names)
                    if key not in open_:
                        source, part = key
                        stem = source.rsplit(".", 1)[0] + (f".part{part:04d}" if (parts or {}).get(source, 1) > 1 else "")
                        meta = {k.encode(): v.encode() for k, v in footers.get(source, {}).items()}
                        open_[key] = PartWriter(folder, f"{stem}{suffix}", attempt, rows.schema.with_metadata(meta), compression)
                    open_[key].write(rows)
                    if geometry:
                        boxes.setdefault(key, []).append(bounds_of(rows["geometry"].to_pylist()))
            done += [finish(key, w, boxes.get(key, [])) for key, w in open_.items()]
            open_.clear()
        except BaseException:
            for w in open_.values():
                w.drop()
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["source_file", "path", "n"])

    def finish(key, writer, found):
        extra = None
        if geometry:
            b = np.array([x for x in found if x] or [[0.0] * 4])
            bounds = [float(v) for v in (*b[:, :2].min(0), *b[:, 2:].max(0))]
            extra = {"geo": json.dumps(geo_metadata(bounds, geometry, covering=covering))}
        writer.close(extra)
        return key[0], writer.path, writer.n

    return dealt.mapInArrow(write, "source_file string, path string, n long")


def write_summary(df: DataFrame, path: str) -> None:
    """All columns but the geometry, as one CSV file."""
    df.drop("geometry").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(path: str, entries: dict) -> None:
    files, at = store(path)
    with files.open_output_stream(f"{at}.new") as f:
        f.write(json.dumps(entries, indent=2).encode())
    files.move(f"{at}.new", at)


def put(local: str, target: str) -> None:
    """A local file to its place, in any store."""
    files, at = store(target)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with open(local, "rb") as source, files.open_output_stream(f"{at}.new") as out:
        while block := source.read(1 << 20):
            out.write(block)
    files.move(f"{at}.new", at)


def write_geopackage(polygons: DataFrame, path: str, layer: str, epsg: int = 3035) -> int:
    """A polygon summary as a GeoPackage, made on the driver row by row and then put in its place."""
    with tempfile.TemporaryDirectory() as folder:
        n = _geopackage(polygons, f"{folder}/made.gpkg", layer, epsg)
        put(f"{folder}/made.gpkg", path)
    return n


def _geopackage(polygons: DataFrame, path: str, layer: str, epsg: int) -> int:
    columns = [c for c in polygons.columns if c != "geometry"]
    # The tables, names and numbers of the format.
    db = sqlite3.connect(path)
    db.execute("pragma application_id = 1196444487")
    db.execute("pragma user_version = 10300")
    db.execute("create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)")
    db.execute("create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer)")
    db.execute("create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null)")
    for srs, code, maker in (("undefined cartesian", -1, "NONE"), ("undefined geographic", 0, "NONE"), ("WGS 84", 4326, "EPSG"), *([] if epsg == 4326 else [(f"EPSG:{epsg}", epsg, "EPSG")])):
        db.execute("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, 'undefined', null)", (srs, code, maker, code))
    kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "boolean": "boolean", "binary": "blob"}
    typed = ", ".join(f'"{c}" {kinds.get(polygons.schema[c].dataType.simpleString(), "text")}' for c in columns)
    db.execute(f'create table "{layer}" (fid integer primary key autoincrement not null, geom polygon' + (f", {typed})" if columns else ")"))
    n, whole = 0, None
    for row in polygons.toLocalIterator():
        blob = None
        if row["geometry"] is not None:
            ring = read_polygon(bytes(row["geometry"]))
            (west, south), (east, north) = ring.min(0), ring.max(0)
            whole = [west, south, east, north] if whole is None else [min(whole[0], west), min(whole[1], south), max(whole[2], east), max(whole[3], north)]
            blob = b"GP" + struct.pack("<BBi4d", 0, 3, epsg, west, east, south, north) + bytes(row["geometry"])
        n += 1
        db.execute(f'insert into "{layer}" values ({", ".join("?" * (len(columns) + 2))})', (n, blob, *[row[c] for c in columns]))
    db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *map(float, whole or [0] * 4), epsg))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, epsg))
    db.commit()
    db.close()
    return n


# What the .prj file of longitude and latitude says.
_PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def write_shapefile(polygons: DataFrame, path: str) -> int:
    """A polygon summary in degrees as <path>.shp, .shx, .dbf and .prj; names are cut to ten characters. Made on the driver row
    by row."""
    columns = [c for c in polygons.columns if c != "geometry"]
    short = short_names(columns)
    # a field's letter, width and decimals
    forms = {c: {"bigint": (b"N", 18, 0), "int": (b"N", 11, 0), "double": (b"N", 24, 9), "float": (b"N", 24, 9), "boolean": (b"L", 1, 0)}.get(polygons.schema[c].dataType.simpleString(), (b"C", 254, 0)) for c in columns}

    def cell(value, form) -> bytes:
        letter, width, decimals = form
        if letter == b"C":
            return ("" if value is None else str(value)).encode()[:width].decode(errors="ignore").encode().ljust(width)
        if letter == b"L":
            return b"?" if value is None else b"T" if value else b"F"
        return (b"" if value is None else (f"{value:.{decimals}f}" if decimals else str(value)).encode()).rjust(width)[:width]

    shapes, index, table, at, n, whole = [], [], [], 50, 0, []
    for row in polygons.toLocalIterator():
        n += 1
        if row["geometry"] is None:
            body = struct.pack("<i", 0)
        else:
            ring = read_polygon(bytes(row["geometry"]))
            x, y = ring.T
            if (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() > 0:  # outer rings run clockwise here
                ring = ring[::-1]
            box = [*ring.min(0), *ring.max(0)]
            whole.append(box)
            body = struct.pack("<i4diii", 5, *box, 1, len(ring), 0) + np.ascontiguousarray(ring, "<f8").tobytes()
        shapes.append(struct.pack(">ii", n, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += 4 + len(body) // 2
        table.append(b" " + b"".join(cell(row[c], forms[c]) for c in columns))
    b = np.array(whole or [[0.0] * 4])
    box = [*b[:, :2].min(0), *b[:, 2:].max(0)]
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)
    fields = b"".join(short[c].encode()[:10].ljust(11, b"\0") + forms[c][0] + b"\0" * 4 + bytes(forms[c][1:]) + b"\0" * 14 for c in columns)
    size = 1 + sum(forms[c][1] for c in columns)
    dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, n, 33 + len(fields), size) + fields + b"\r" + b"".join(table) + b"\x1a"
    made = {".shp": head(at) + b"".join(shapes), ".shx": head(50 + 4 * n) + b"".join(index), ".dbf": dbf, ".prj": _PRJ.encode()}
    with tempfile.TemporaryDirectory() as folder:
        for ending, data in made.items():
            with open(f"{folder}/made", "wb") as f:
                f.write(data)
            put(f"{folder}/made", path + ending)
    return n


def records(df: DataFrame) -> DataFrame:
    """A JSON object a row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
