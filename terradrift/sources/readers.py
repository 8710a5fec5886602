"""Readers: raw CSV and TXT, ZIP archives, Parquet by name across differing files, pairs, polygons."""

from __future__ import annotations

import csv
import io
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terradrift.ship import ship


def file_name():
    """The name of the file that a row comes from."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("source_file")


def list_files(spark: SparkSession, folder: str, *suffixes: str, recursive: bool = False) -> list[str]:
    """Sorted paths under folder, in any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found, files = [], path.getFileSystem(conf).listFiles(path, recursive)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.lower().endswith(tuple(s.lower() for s in suffixes)):
            found.append(name)
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Bytes of each file."""
    conf, kind = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return {p: kind(p).getFileSystem(conf).getFileStatus(kind(p)).getLen() for p in paths}


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: its first line, read by the driver without a Spark job."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    if not line or not line.lstrip("\ufeff"):
        return []
    return next(csv.reader([line.lstrip("\ufeff")]))


def parquet_columns(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """What a file's columns are, as text, and its key-value pairs, from its footer, without a Spark job."""
    jvm = spark._jvm
    target = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(target)
    try:
        data = reader.getFooter().getFileMetaData()
        return data.getSchema().toString(), dict(data.getKeyValueMetaData())
    finally:
        reader.close()


def by_columns(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """Files grouped by equal columns; footers are read side by side."""
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for f, (columns, _) in zip(files, pool.map(lambda f: parquet_columns(spark, f), files), strict=True):
            groups.setdefault(columns, []).append(f)
    return list(groups.values())


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, with source_file (the file's name). Files may differ in their columns."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    groups: dict[tuple, list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for p, names in zip(paths, pool.map(lambda p: tuple(header(spark, p)), paths), strict=True):
            groups.setdefault(names, []).append(p)
    for names, files in groups.items():
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(kind).option("header", True).option("enforceSchema", True).csv(files).select("*", file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_zip(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines of the first .csv member of each archive (source_file named after the archive, line number, line),
    and the archives that could not be read. An archive is one task: the format has no splits."""
    ship(spark)
    rows = spark.read.format("binaryFile").load(paths)

    def lines(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".csv"
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        member = next(m for m in z.namelist() if m.lower().endswith(".csv"))
                        with z.open(member) as f:
                            text = f.read().decode("utf-8-sig").splitlines()
                    yield pd.DataFrame({"source_file": name, "n": range(len(text)), "line": text, "error": None})
                except Exception as e:  # a bad archive is reported, the others go on
                    yield pd.DataFrame({"source_file": [name], "n": [-1], "line": [None], "error": [f"{type(e).__name__}: {e}"]})

    out = rows.select("path", "content").mapInPandas(lines, "source_file string, n long, line string, error string")
    return out.where("error is null").drop("error"), out.where("error is not null").select("source_file", "error")


def csv_from_lines(lines: DataFrame) -> DataFrame:
    """Text columns and source_file of archive lines; archives are grouped by equal headers (one line each)."""
    heads = lines.where("n = 0").select("source_file", F.col("line").alias("head")).collect()  # a row a file
    out = None
    for head in sorted({h["head"] for h in heads}):
        files = [h["source_file"] for h in heads if h["head"] == head]
        names = lines.sparkSession.read.csv(lines.sparkSession.sparkContext.parallelize([head]), header=True).columns
        kind = ", ".join(f"`{n}` string" for n in names)
        body = lines.where((F.col("n") > 0) & F.col("source_file").isin(files))
        df = body.select("source_file", F.from_csv("line", kind).alias("r")).select("source_file", "r.*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no readable archive")
    return out


def read_deliveries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """Raw rows of a folder: its .csv and .txt files, or its archives where it has none; and unreadable archives."""
    if files := list_files(spark, folder, ".csv", ".txt"):
        return read_csv(spark, files), None
    lines, bad = read_zip(spark, list_files(spark, folder, ".zip"))
    return csv_from_lines(lines), bad


def read_parquet_by_name(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Union by name with nulls for missing columns and source_file; files are read per schema and widened, which
    one merged read refuses for differing types."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [f for p in paths for f in (list_files(spark, p, pattern or ".parquet", recursive=True) if not p.endswith(".parquet") else [p])]
    out = None
    for group in by_columns(spark, files):
        df = spark.read.parquet(*group).select("*", file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def pair_files(spark: SparkSession, folder: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(metadata, series) files that share a stem, and metadata files without a series, which callers name and leave out."""
    meta = list_files(spark, folder, "_meta.parquet", recursive=True)
    series = set(list_files(spark, folder, "_ts.parquet", recursive=True))
    mate = lambda m: m[: -len("_meta.parquet")] + "_ts.parquet"
    return [(m, mate(m)) for m in meta if mate(m) in series], [m for m in meta if mate(m) not in series]


def point_files(paths: list[str]) -> list[str]:
    """Without polygon outputs."""
    return [p for p in paths if "clusters_" not in p.rsplit("/", 1)[-1] and "subcluster" not in p.rsplit("/", 1)[-1]]


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> tuple[DataFrame, int]:
    """A layer of a GeoPackage (SQLite) file, the first one unless named, and its EPSG code. The file is fetched to the driver;
    geometry blobs lose their header and become WKB. A layer is a polygon summary, small beside the points."""
    import sqlite3
    import tempfile

    from terradrift.sources.sinks import store

    files, at = store(path)
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as copy:
        with files.open_input_stream(at) as source:
            while block := source.read(1 << 20):
                copy.write(block)
        copy.flush()
        with sqlite3.connect(f"file:{copy.name}?mode=ro", uri=True) as db:
            where = "" if layer is None else " where table_name = ?"
            layer, column, epsg = db.execute(f"select table_name, column_name, srs_id from gpkg_geometry_columns{where}", () if layer is None else (layer,)).fetchone()
            kinds = {r[1]: {"INTEGER": "long", "REAL": "double", "BOOLEAN": "boolean", "BLOB": "binary"}.get((r[2] or "").upper(), "string") for r in db.execute(f'pragma table_info("{layer}")')}
            cursor = db.execute(f'select * from "{layer}"')
            names = [c[0] for c in cursor.description]
            rows = [list(r) for r in cursor]
    at_ = names.index(column)
    for r in rows:
        if r[at_] is not None:
            blob = bytes(r[at_])
            r[at_] = blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]
        for k, name in enumerate(names):
            if kinds[name] == "boolean" and r[k] is not None:
                r[k] = bool(r[k])
    schema = ", ".join(f"`{'geometry' if n == column else n}` {'binary' if n == column else kinds[n]}" for n in names)
    return spark.createDataFrame(rows, schema), epsg


def read_polygons(spark: SparkSession, data_dir: str, name: str) -> DataFrame | None:
    """Polygons in degrees by that name: of subclusters the GeoPackage where there is one, else the GeoParquet folder; None where
    there is neither. Coordinates in another system are brought to degrees, and an unknown system is an error."""
    from terradrift.functions.geometry import to_degrees
    from terradrift.sources.sinks import geo_epsg

    if name.startswith("sub") and exists(spark, f"{data_dir}/{name}.gpkg"):
        shapes, epsg = read_geopackage(spark, f"{data_dir}/{name}.gpkg")
        shapes = shapes.drop("fid")
    elif exists(spark, f"{data_dir}/{name}"):
        files = list_files(spark, f"{data_dir}/{name}", ".parquet")
        found = {geo_epsg({k.encode(): v for k, v in parquet_columns(spark, f)[1].items()}) for f in files} - {None}
        if len(found) > 1:
            raise ValueError(f"{name}: files of several coordinate systems")
        shapes, epsg = spark.read.parquet(f"{data_dir}/{name}"), found.pop() if found else 4326
    else:
        return None
    if epsg == 4326:
        return shapes
    if epsg != 3035:
        raise ValueError(f"{name}: coordinate system EPSG:{epsg} is not known")
    return shapes.withColumn("geometry", to_degrees("geometry"))
