"""Geometry on the sphere and on regular lattices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance in km between two points in degrees (column names or SQL)."""
    half_lat, half_lon = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    a = f"({half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) * {half_lon} * {half_lon})"
    # a may pass 1 by one rounding step for antipodes
    return F.expr(f"{EARTH_RADIUS_KM}D * 2 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0D)))")


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Initial bearing in degrees [0, 360) from point 1 to point 2."""
    dlon = f"radians({lon2} - {lon1})"
    east = f"sin({dlon}) * cos(radians({lat2}))"
    north = (f"cos(radians({lat1})) * sin(radians({lat2})) "
             f"- sin(radians({lat1})) * cos(radians({lat2})) * cos({dlon})")
    turn = f"degrees(atan2({east}, {north}))"
    return F.expr(f"CASE WHEN {turn} < 0 THEN {turn} + 360 ELSE {turn} END")


Place = tuple[str, str]  # SQL of latitude and longitude


def side_sql(p: Place, a: Place, b: Place) -> str:
    """SQL whose sign tells the side of the line a-b that P is on."""
    (plat, plon), (alat, alon), (blat, blon) = p, a, b
    return f"({plat} - {blat}) * ({alon} - {blon}) - ({alat} - {blat}) * ({plon} - {blon})"


def point_in_triangle(p: Place, a: Place, b: Place, c: Place) -> Column:
    """True if P lies in the triangle or on its edge (planar, in degrees).

    Outside exactly if P is left of one side and right of another; a
    degenerate triangle holds the points of its whole line.
    """
    sides = ", ".join(side_sql(p, x, y) for x, y in ((a, b), (b, c), (c, a)))
    return F.expr(f"NOT (least({sides}) < 0 AND greatest({sides}) > 0)")


def unit_vector(lat: str, lon: str) -> list[str]:
    """SQL of the point on the unit sphere; straight-line distance there has no pole or date line."""
    return [f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))",
            f"sin(radians({lat}))"]


def lattice_shape(lat_min, lat_max, lon_min, lon_max, step) -> tuple[int, int]:
    """Rows and columns of the inclusive lattice over a box."""
    return round((lat_max - lat_min) / step) + 1, round((lon_max - lon_min) / step) + 1


def cell_id_of(lat, lon, lat_min, lat_max, lon_min, lon_max, step) -> Column:
    """Row-major id (from 1) of the lattice cell that holds a point; null outside."""
    rows, cols = lattice_shape(lat_min, lat_max, lon_min, lon_max, step)
    i = F.floor((lat - F.lit(lat_min)) / F.lit(step) + F.lit(0.5))
    j = F.floor((lon - F.lit(lon_min)) / F.lit(step) + F.lit(0.5))
    inside = i.between(0, rows - 1) & j.between(0, cols - 1)
    return F.when(inside, i * cols + j + 1)


def tile_name(lat, lon) -> Column:
    """Name of the one-degree elevation tile whose south-west corner holds the point."""
    south, west = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.format_string(
        "%s%02d%s%03d.hgt",
        F.when(south >= 0, "N").otherwise("S"), F.abs(south),
        F.when(west >= 0, "E").otherwise("W"), F.abs(west),
    )
