"""Distances, projections and tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.57


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, longitudes shrunk at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * KM_PER_DEGREE_LON
    dy = (lat2 - lat1) * KM_PER_DEGREE_LAT
    return F.sqrt(dx * dx + dy * dy)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies in a box, its edges included; null coordinates and NaN do not."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def cell(x: Column, origin: float, step: float) -> Column:
    """Index of the grid cell that holds x."""
    return F.floor((x - origin) / step).cast("bigint")


def arc_minute(k: Column) -> Column:
    """Whether a coordinate in thousandths of a degree looks rounded to arc minutes."""
    return F.abs(60 * k - 1000 * F.rint(60 * k / 1000.0)) <= 30


def half_up_cell(k: Column, offset: int) -> Column:
    """Hundredths, rounded half up, of a coordinate in thousandths counted from -offset."""
    return F.floor((k + offset + 5) / 10).cast("bigint")


def tile_x(lon: Column, z: int) -> Column:
    return F.floor((lon + 180) / 360 * (1 << z)).cast("bigint")


def tile_y(lat: Column, z: int) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * (1 << z)).cast("bigint")


def tile_west(x: Column, z: Column | int) -> Column:
    return x / F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z)) * 360 - 180


def tile_north(y: Column, z: Column | int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))))))


def tile_id(z: int, x: Column, y: Column) -> Column:
    """Tiles of all lower zooms plus the index on the Hilbert curve of this one (PMTiles order)."""
    base = ((1 << (2 * z)) - 1) // 3
    if not z:
        return F.lit(base).cast("bigint")
    start = F.struct(F.lit(base).cast("bigint").alias("a"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = F.expr("1L").cast("bigint")
        n = F.call_function("shiftleft", side, k)
        rx, ry = F.when(s.x.bitwiseAND(n) != 0, 1).otherwise(0).cast("bigint"), F.when(s.y.bitwiseAND(n) != 0, 1).otherwise(0).cast("bigint")
        # only the bits below n matter from here
        low_x, low_y = s.x.bitwiseAND(n - 1), s.y.bitwiseAND(n - 1)
        flip = (ry == 0) & (rx == 1)
        nx, ny = F.when(flip, n - 1 - low_x).otherwise(low_x), F.when(flip, n - 1 - low_y).otherwise(low_y)
        return F.struct((s.a + n * n * (3 * rx).bitwiseXOR(ry)).alias("a"), F.when(ry == 0, ny).otherwise(nx).alias("x"), F.when(ry == 0, nx).otherwise(ny).alias("y"))

    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0)), start, step)["a"]


def tile_of_id(i: Column) -> Column:
    """struct of z, x, y: the inverse of tile_id."""
    base = lambda z: (F.pow(F.lit(4.0), z).cast("bigint") - 1) / 3
    z = F.aggregate(F.sequence(F.lit(1), F.lit(26)), F.lit(0), lambda a, k: F.when(base(k) <= i, k).otherwise(a))
    start = F.struct((i - base(z).cast("bigint")).alias("t"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))

    def step(s: Column, k: Column) -> Column:
        n = F.call_function("shiftleft", F.expr("1L"), k)
        rx = F.call_function("shiftright", s.t, F.lit(1)).bitwiseAND(F.lit(1))
        ry = s.t.bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, n - 1 - s.x).otherwise(s.x), F.when(flip, n - 1 - s.y).otherwise(s.y)
        x, y = F.when(ry == 0, fy).otherwise(fx) + n * rx, F.when(ry == 0, fx).otherwise(fy) + n * ry
        return F.struct(F.call_function("shiftright", s.t, F.lit(2)).cast("bigint").alias("t"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))

    done = F.when(z > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(z - 1, F.lit(0))), start, step)).otherwise(start)
    return F.struct(z.alias("z"), done["x"].alias("x"), done["y"].alias("y"))


#: GDA94 / MGA zone 55: ellipsoid, scale, false origin, central meridian.
A, F_INV, K0, E0, N0, LON0 = 6378137.0, 298.257222101, 0.9996, 500000.0, 10000000.0, 147.0


def mga55(lat: Column, lon: Column) -> Column:
    """struct of easting and northing: Krueger's series for the transverse Mercator, to the sixth order."""
    f = 1 / F_INV
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    big_a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((E0 + K0 * big_a * x).alias("e"), (N0 + K0 * big_a * y).alias("n"))
