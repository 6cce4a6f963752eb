"""Scalar functions: numbers, arrays, clock strings, projections, segments and links. All stay inside Catalyst."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the radius of the spherical Mercator projection, in metres.
EARTH_RADIUS = 6378137.0


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a seed and keys, by MD5: the same on every run and in any engine, whatever the partitioning."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, *keys: str) -> str:
    """:func:`uniform` as DuckDB's SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def digits(x: Column, n: int) -> Column:
    """``x`` cut down to ``n`` decimals."""
    return F.floor(x * 10.0**n) / 10.0**n


def rel_square(x: Column, y: Column) -> Column:
    """Squared relative error, (2 (x - y) / (x + y))^2."""
    return F.pow(2.0 * (x - y) / (x + y), F.lit(2.0))


def array_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def checked_points(points: Column) -> Column:
    """The array of points, or an error if it is empty or its points differ in size."""
    good = (F.size(points) > 0) & (F.size(F.array_distinct(F.transform(points, F.size))) == 1)
    return F.when(good, points).otherwise(F.raise_error(F.lit("points must be non-empty and of one dimension")))


def clock(hours: Column) -> Column:
    """Decimal hours as H:M:S, without padding."""
    h = F.floor(hours)
    m = F.floor((hours - h) * 60)
    s = F.floor(((hours - h) * 60 - m) * 60)
    return F.concat_ws(":", *[x.cast("int").cast("string") for x in (h, m, s)])


def exp_cost(distance: Column, decay: Column | float) -> Column:
    return F.exp(-distance / decay)


def exp_cost_inverse(weight: Column, decay: Column | float) -> Column:
    return -decay * F.ln(weight) if isinstance(decay, Column) else F.lit(-float(decay)) * F.ln(weight)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to spherical Mercator metres."""
    return F.radians(lon) * EARTH_RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.lit(math.pi / 2))


def window_around(lon: Column, lat: Column, size: float) -> tuple[Column, Column, Column, Column]:
    """lon min, lat min, lon max, lat max of a square of ``size`` metres around a point."""
    x, y = to_mercator(lon, lat)
    low, high = from_mercator(x - size / 2, y - size / 2), from_mercator(x + size / 2, y + size / 2)
    return low[0], low[1], high[0], high[1]


def reprojected(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between EPSG:4326 and EPSG:3857; other systems are refused."""
    if source == target:
        return x, y
    if (source, target) == ("EPSG:4326", "EPSG:3857"):
        return to_mercator(x, y)
    if (source, target) == ("EPSG:3857", "EPSG:4326"):
        return from_mercator(x, y)
    raise ValueError(f"no closed form from {source} to {target}")


def transposed(coords: Column) -> Column:
    """Coordinates with x and y exchanged."""
    return F.transform(coords, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def rescaled(coords: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Coordinates mapped from a box to the unit box."""
    return F.transform(coords, lambda p: F.struct(((p["x"] - xmin) / (xmax - xmin)).alias("x"), ((p["y"] - ymin) / (ymax - ymin)).alias("y")))


def ring_area(coords: Column) -> Column:
    """Area of a ring of (x, y), closed or not, by the shoelace formula."""
    n = F.size(coords)
    term = lambda p, k: p["x"] * F.get(coords, (k + 1) % n)["y"] - F.get(coords, (k + 1) % n)["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(coords, term), F.lit(0.0), lambda a, t: a + t)) / 2


def in_ring(x: Column, y: Column, coords: Column) -> Column:
    """Is the point inside the ring? Even-odd ray casting."""
    n = F.size(coords)

    def crosses(p: Column, k: Column) -> Column:
        q = F.get(coords, (k + 1) % n)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    return F.aggregate(F.transform(coords, lambda p, k: F.coalesce(crosses(p, k), F.lit(False)).cast("int")), F.lit(0), lambda a, c: a + c) % 2 == 1


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle of a link to the x axis; a vertical link gives plus or minus a quarter turn."""
    return F.when(x1 == x2, F.signum(y2 - y1) * (math.pi / 2)).otherwise(F.atan((y2 - y1) / (x2 - x1)))


def within_extent(v: Column, a: Column, b: Column) -> Column:
    return v.between(F.least(a, b), F.greatest(a, b))


def link_id(src: Column, dst: Column) -> Column:
    """An undirected link's id."""
    return F.struct(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))


def project_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of a segment that is nearest to (px, py)."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length)))
    return x1 + t * dx, y1 + t * dy


def segments_cross(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Do two segments (x1, y1, x2, y2) meet at one inner point; and the point. Shared ends, parallels and points don't count."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    denominator = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / denominator
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / denominator
    same = lambda px, py, qx, qy: (px == qx) & (py == qy)
    shared = same(ax, ay, cx, cy) | same(ax, ay, dx, dy) | same(bx, by, cx, cy) | same(bx, by, dx, dy)
    meets = F.coalesce((denominator != 0) & ~shared & t.between(0.0, 1.0) & u.between(0.0, 1.0), F.lit(False))
    return meets, ax + t * (bx - ax), ay + t * (by - ay)


def looked_up(code: Column, names: Mapping[object, str]) -> Column:
    """A code's name, null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), code)


def wealth(population: Column, exponent: float) -> Column:
    return F.pow(population, F.lit(exponent))


def interaction_potential(mass1: Column, mass2: Column, weight: Column) -> Column:
    return F.abs(mass1) * F.abs(mass2) * weight


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low)
