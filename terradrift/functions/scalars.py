"""Column functions of the point model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradrift import schema


def orbit(track_angle: Column) -> Column:
    """A(scending), D(escending) strictly between 90 and 270 degrees, U(nknown) without an angle."""
    angle = F.pmod(track_angle, F.lit(360.0))
    return F.when(track_angle.isNull() | F.isnan(track_angle), "U").when((angle > 90) & (angle < 270), "D").otherwise("A")


def decimal_year(day: Column) -> Column:
    start = F.trunc(day, "year")
    return F.year(day) + F.datediff(day, start) / F.datediff(F.add_months(start, 12), start)


def finite(x: Column) -> Column:
    """Null for NaN and infinities, which compare as the greatest values otherwise."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(text: Column, kind: str) -> Column:
    """Text to a number, null where it is none; suffixed literals such as 1.5d are none."""
    bare = F.trim(text)
    plain = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = plain.try_cast("double")
        return F.when(value == F.floor(value), value).try_cast(kind)
    return plain.try_cast(kind)


def bare_date(name: str) -> str | None:
    """YYYYMMDD of a date column's name, with or without a leading D; None for others."""
    bare = name[1:] if name[:1] == "D" else name
    return bare if len(bare) == 8 and bare.isascii() and bare.isdigit() else None


def display_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def cluster_id(n: Column) -> Column:
    return F.when(n.isNull() | (n < 0), schema.NOISE).otherwise(F.format_string("CL_%04d", n))


def subcluster_id(parent: Column, n: Column) -> Column:
    return F.when(n.isNull() | (n < 0), F.concat(parent, F.lit("_SUB_NOISE"))).otherwise(F.format_string("%s_SUB_%03d", parent, n))


def class_color(name: Column) -> Column:
    colors = F.create_map(*[F.lit(x) for pair in schema.COLORS.items() for x in pair])
    return F.coalesce(F.try_element_at(colors, name), F.lit(schema.NO_COLOR))


def safe_pid(text: Column) -> Column:
    """Letters, digits, hyphens and underscores only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def box_name(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Folder name of a bounding box, such as bbox_44.00N_45.50N_7.00E_9.25E."""
    one = lambda v, plus, minus: F.concat(F.format_string("%.2f", F.abs(v)), F.when(v >= 0, plus).otherwise(minus))
    return F.concat_ws("_", F.lit("bbox"), one(south, "N", "S"), one(north, "N", "S"), one(west, "E", "W"), one(east, "E", "W"))


def short_names(names: list[str], width: int = 10) -> dict[str, str]:
    """Names cut to width; a repeated one keeps two characters less and takes a two-digit count."""
    taken: list[str] = []
    out = {}
    for name in names:
        short = name[:width]
        if short in taken:
            stem = name[: width - 2]
            short = f"{stem}{len([t for t in taken if t.startswith(stem)]):02d}"
        taken.append(short)
        out[name] = short
    return out
