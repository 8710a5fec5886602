"""Geometry without a spatial library: WKB, convex hulls, round buffers, and the equal-area projection of Europe
(EPSG 3035). Kernels work on NumPy arrays; the column functions wrap them for Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# GRS80 ellipsoid and the projection's origin.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
LAT0, LON0, EAST0, NORTH0 = np.radians(52.0), np.radians(10.0), 4321000.0, 3210000.0
_E2 = FLATTENING * (2 - FLATTENING)
_E = np.sqrt(_E2)


def _q(sin_lat):
    return (1 - _E2) * (sin_lat / (1 - _E2 * sin_lat**2) - np.log((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E))


_QP = _q(1.0)
_RQ = AXIS * np.sqrt(_QP / 2)
_BETA0 = np.arcsin(_q(np.sin(LAT0)) / _QP)
_D = AXIS * np.cos(LAT0) / np.sqrt(1 - _E2 * np.sin(LAT0) ** 2) / (_RQ * np.cos(_BETA0))


def to_laea(lon, lat):
    """Degrees to metres."""
    beta = np.arcsin(np.clip(_q(np.sin(np.radians(lat))) / _QP, -1, 1))
    dlon = np.radians(lon) - LON0
    b = _RQ * np.sqrt(2 / (1 + np.sin(_BETA0) * np.sin(beta) + np.cos(_BETA0) * np.cos(beta) * np.cos(dlon)))
    x = b * _D * np.cos(beta) * np.sin(dlon)
    y = b / _D * (np.cos(_BETA0) * np.sin(beta) - np.sin(_BETA0) * np.cos(beta) * np.cos(dlon))
    return EAST0 + x, NORTH0 + y


def from_laea(east, north):
    """Metres to degrees."""
    x, y = np.asarray(east, float) - EAST0, np.asarray(north, float) - NORTH0
    rho = np.hypot(x / _D, _D * y)
    c = 2 * np.arcsin(np.clip(rho / (2 * _RQ), -1, 1))
    safe = np.where(rho == 0, 1, rho)
    beta = np.arcsin(np.clip(np.cos(c) * np.sin(_BETA0) + np.where(rho == 0, 0, _D * y * np.sin(c) * np.cos(_BETA0) / safe), -1, 1))
    lon = LON0 + np.arctan2(x * np.sin(c), _D * rho * np.cos(_BETA0) * np.cos(c) - _D**2 * y * np.sin(_BETA0) * np.sin(c))
    lat = np.where(rho == 0, LAT0, beta)
    for _ in range(8):  # authalic to geodetic latitude
        s = np.sin(lat)
        lat = lat + (1 - _E2 * s**2) ** 2 / (2 * np.cos(lat)) * (_QP * np.sin(beta) / (1 - _E2) - s / (1 - _E2 * s**2) + np.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return np.degrees(lon), np.degrees(lat)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise; collinear points give their two ends, equal points one."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def buffered(corners: np.ndarray, radius: float, segments: int = 32) -> np.ndarray:
    """Ring around a convex set of corners (a point, a segment or a polygon) at radius, with round corners of
    `segments` steps a quarter."""
    m = len(corners)
    if m == 1:
        turn = np.linspace(0, 2 * np.pi, 4 * segments, endpoint=False)
        return corners[0] + radius * np.column_stack([np.cos(turn), np.sin(turn)])
    ahead = np.roll(corners, -1, 0) - corners
    out_angle = np.arctan2(ahead[:, 1], ahead[:, 0]) - np.pi / 2
    ring = []
    for i in range(m):
        first, last = out_angle[i - 1], out_angle[i]
        sweep = (last - first) % (2 * np.pi)
        steps = max(1, int(np.ceil(sweep / (np.pi / 2 / segments))))
        a = first + sweep * np.arange(steps + 1) / steps
        ring.append(corners[i] + radius * np.column_stack([np.cos(a), np.sin(a)]))
    return np.concatenate(ring)


def hull_ring(points: np.ndarray, radius: float, segments: int = 32) -> np.ndarray | None:
    """Ring of the buffered hull; a lone point or a pair first becomes a disc or a capsule of one metre."""
    if not len(points):
        return None
    corners = convex_hull(points)
    return buffered(corners, radius + (1.0 if len(points) < 3 else 0.0), segments)


def area_centroid(ring: np.ndarray) -> tuple[float, float, float]:
    origin = ring[0]
    x, y = (ring - origin).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    twice = cross.sum()
    if twice == 0:
        return 0.0, *ring.mean(0)
    return abs(twice) / 2, origin[0] + ((x + np.roll(x, -1)) * cross).sum() / (3 * twice), origin[1] + ((y + np.roll(y, -1)) * cross).sum() / (3 * twice)


def polygon_wkb(ring: np.ndarray) -> bytes:
    closed = np.vstack([ring, ring[:1]])
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + closed.astype("<f8").tobytes()


def read_polygon(wkb: bytes) -> np.ndarray:
    """Outer ring, closed, of a little-endian polygon."""
    order, kind, rings, n = struct.unpack("<BIII", wkb[:13])
    if order != 1 or kind != 3 or rings < 1:
        raise ValueError("not a little-endian WKB polygon")
    return np.frombuffer(wkb[13 : 13 + 16 * n], "<f8").reshape(n, 2)


def reproject_polygon(wkb: bytes | None) -> bytes | None:
    """A polygon in metres to one in degrees."""
    if wkb is None:
        return None
    lon, lat = from_laea(*read_polygon(wkb)[:-1].T)
    return polygon_wkb(np.column_stack([lon, lat]))


@F.pandas_udf(T.BinaryType())
def point_wkb(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if a != a or b != b else struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(lon.astype(float), lat.astype(float), strict=True)])


@F.pandas_udf(T.StructType().add("easting", "double").add("northing", "double"))
def project(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    east, north = to_laea(lon.to_numpy(float), lat.to_numpy(float))
    return pd.DataFrame({"easting": east, "northing": north})


@F.pandas_udf(T.BinaryType())
def to_degrees(geometry: pd.Series) -> pd.Series:
    return geometry.map(reproject_polygon)


@F.pandas_udf(T.StringType())
def geometry_json(geometry: pd.Series) -> pd.Series:
    def one(wkb):
        if wkb is None:
            return None
        ring = ", ".join(f"[{x!r}, {y!r}]" for x, y in read_polygon(wkb).tolist())
        return f'{{"type": "Polygon", "coordinates": [[{ring}]]}}'

    return geometry.map(one)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def geometry_box(geometry: pd.Series) -> pd.Series:
    """West, south, east and north."""
    return geometry.map(lambda wkb: None if wkb is None else [float(v) for r in [read_polygon(wkb)] for v in (*r.min(0), *r.max(0))])


def feature_rows(polygons: DataFrame, geometry: str = "geometry") -> DataFrame:
    """GeoJSON features with their bounds, one string a row; null properties are left out."""
    properties = F.to_json(F.struct(*[c for c in polygons.columns if c != geometry]))
    box = F.coalesce(F.concat(F.lit(', "bbox": ['), F.array_join(geometry_box(F.col(geometry)), ", "), F.lit("]")), F.lit(""))
    return polygons.select(F.concat(F.lit('{"type": "Feature", "properties": '), properties, box, F.lit(', "geometry": '), F.coalesce(geometry_json(F.col(geometry)), F.lit("null")), F.lit("}")).alias("feature"))


def collection(features: list[str]) -> str:
    """A FeatureCollection of feature_rows, with the bounds of all."""
    import json

    boxes = np.array([b for f in features if (b := json.loads(f).get("bbox"))])
    whole = f'"bbox": {[float(v) for v in (*boxes[:, :2].min(0), *boxes[:, 2:].max(0))]}, ' if len(boxes) else ""
    return f'{{"type": "FeatureCollection", {whole}"features": [' + ",".join(features) + "]}"


