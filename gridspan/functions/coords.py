"""Coordinate systems as Column expressions: mesh codes, plane metres, cells, pixels and the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GRS80 and the plane-rectangular zone IX of JGD2011 (public parameters of EPSG:6677).
A, INVERSE_F, SCALE0 = 6378137.0, 298.257222101, 0.9999
ZONE_IX, ZONE_VIII = (36.0, 139.0 + 50.0 / 60), (36.0, 138.5)


def digit(code: Column, at: int, n: int = 1) -> Column:
    return F.substring(code, at + 1, n).cast("int")


def mesh_bounds(code: Column) -> Column:
    """struct(lat0, lat1, lon0, lon1) of a 6- or 8-digit mesh code."""
    lat = (digit(code, 0, 2) * 40 + digit(code, 4) * 5) / 60
    lon = 100 + digit(code, 2, 2) + digit(code, 5) * 7.5 / 60
    third = F.length(code) >= 8
    lat0 = F.when(third, lat + F.try_to_number(F.substring(code, 7, 1), F.lit("9")).cast("double") * 0.5 / 60).otherwise(lat)
    lon0 = F.when(third, lon + F.try_to_number(F.substring(code, 8, 1), F.lit("9")).cast("double") * 0.75 / 60).otherwise(lon)
    return F.struct(lat0.alias("lat0"), (lat0 + F.when(third, 0.5 / 60).otherwise(5.0 / 60)).alias("lat1"), lon0.alias("lon0"), (lon0 + F.when(third, 0.75 / 60).otherwise(7.5 / 60)).alias("lon1"))


def mesh_code(lat: Column, lon: Column) -> Column:
    """The 8-digit code of the 30 by 45 arc-second mesh that holds a point."""
    a = F.floor(lat * 120)  # units of 30 arc-seconds
    o = F.floor((lon - 100) * 80)  # units of 45 arc-seconds
    p, u = F.floor(a / 80), F.floor(o / 80)
    q, v = F.floor((a - p * 80) / 10), F.floor((o - u * 80) / 10)
    s, w = a - p * 80 - q * 10, o - u * 80 - v * 10
    return F.concat(F.lpad(p.cast("string"), 2, "0"), F.lpad(u.cast("string"), 2, "0"), *[x.cast("string") for x in (q, v, s, w)])


def series(zone: tuple[float, float] = ZONE_IX) -> dict[str, float]:
    """Constants of the Gauss-Krueger series to the fifth order in n."""
    n = 1 / (2 * INVERSE_F - 1)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880,
        49561 * n**4 / 161280 - 179 * n**5 / 168,
        34729 * n**5 / 80640,
    ]
    arc = [
        1 + n**2 / 4 + n**4 / 64,
        -1.5 * (n - n**3 / 8 - n**5 / 64),
        15 / 16 * (n**2 - n**4 / 4),
        -35 / 48 * (n**3 - 5 * n**5 / 16),
        315 / 512 * n**4,
        -693 / 1280 * n**5,
    ]
    phi0 = math.radians(zone[0])
    s0 = SCALE0 * A / (1 + n) * (arc[0] * phi0 + sum(c * math.sin(2 * k * phi0) for k, c in enumerate(arc) if k))
    return {"a_bar": SCALE0 * A / (1 + n) * arc[0], "s0": s0, "e": 2 * math.sqrt(n) / (1 + n), "lon0": math.radians(zone[1]), **{f"a{j + 1}": c for j, c in enumerate(alpha)}}


def to_plane(lat: Column, lon: Column, zone: tuple[float, float] = ZONE_IX) -> Column:
    """struct(e, n): transverse Mercator, degrees to metres."""
    c = series(zone)
    phi, lam = F.radians(lat), F.radians(lon) - c["lon0"]
    t = F.sinh(F.atanh(F.sin(phi)) - c["e"] * F.atanh(c["e"] * F.sin(phi)))
    tb = F.sqrt(1 + t * t)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / tb)
    north, east = xi, eta
    for j in range(1, 6):
        north = north + c[f"a{j}"] * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c[f"a{j}"] * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((east * c["a_bar"]).alias("e"), (north * c["a_bar"] - c["s0"]).alias("n"))


def web_mercator(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(px, py): global pixels of 256-pixel tiles."""
    size = 256.0 * 2**zoom
    r = F.radians(lat)
    return F.struct(((lon + 180) / 360 * size).alias("px"), ((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * size).alias("py"))


def plane_to_cell(e: Column, n: Column, sw_x: float, sw_y: float, size: float) -> Column:
    """struct(x, z): cells grow east and south."""
    return F.struct((e - sw_x).alias("x"), (sw_y + size - n).alias("z"))


def rotated(x: Column, y: Column, ox: float, oy: float, theta: float) -> Column:
    """struct(u, v): along a street axis, and south of it."""
    c, s = math.cos(theta), math.sin(theta)
    dx, dy = x - ox, y - oy
    return F.struct((dx * c + dy * s).alias("u"), (-(dx * -s + dy * c)).alias("v"))


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column, fx: Column, fz: Column) -> Column:
    return (v00 * (1 - fx) + v10 * fx) * (1 - fz) + (v01 * (1 - fx) + v11 * fx) * fz


#: The vertical datum of the voxel grid and its height.
GROUND_Z, NY_MAX = -12, 512


def surface_voxel(h: Column, gz: float = GROUND_Z) -> Column:
    """Index of the voxel that holds a surface at height h."""
    return (F.ceil(h - gz) - 1).cast("long")


def point_voxel(h: Column, gz: float = GROUND_Z) -> Column:
    """Index of the voxel that holds a sampled point: another rule than for surfaces."""
    return F.floor(h - gz).cast("long")


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.least(F.greatest(v, lit(low)), lit(high))


def quantised_roof(top: Column, surface: Column, step: int) -> Column:
    """A roof snapped to whole floors, at least one floor above the surface."""
    if step <= 1:
        return top
    snapped = (F.floor((top + 1) / F.lit(step) + 0.5) * step).cast("long")
    return clip(F.greatest(snapped, surface + step) - 1, 1, NY_MAX - 8).cast("long")


def newell(ring: Column) -> Column:
    """struct(nx, ny, nz) of a closed ring array<struct<x,y,z>>; the length is twice the area."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(((p["y"] - q["y"]) * (p["z"] + q["z"])).alias("a"), ((p["z"] - q["z"]) * (p["x"] + q["x"])).alias("b"), ((p["x"] - q["x"]) * (p["y"] + q["y"])).alias("c")))
    total = lambda f: F.aggregate(F.transform(pairs, lambda s: s[f]), F.lit(0.0), lambda a, v: a + v)
    return F.struct(total("a").alias("nx"), total("b").alias("ny"), total("c").alias("nz"))


def up_normal(ring: Column) -> Column:
    """The normal's vertical part over its length; 0 for a degenerate ring."""
    n = newell(ring)
    size = F.sqrt(n["nx"] * n["nx"] + n["ny"] * n["ny"] + n["nz"] * n["nz"])
    return F.when(size == 0, 0.0).otherwise(n["nz"] / size)


def unwrapped(lon: Column, low: Column, high: Column) -> Column:
    """A longitude moved east where the set it belongs to spans over half the globe."""
    return F.when((high - low > 180) & (lon < 0), lon + 360).otherwise(lon)


def on_sphere(lon: Column, lat: Column) -> Column:
    o, a = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), F.sin(a).alias("y"), (-F.cos(a) * F.sin(o)).alias("z"))


def arc(p: Column, q: Column) -> Column:
    """Angle between two unit vectors."""
    return F.acos(clip(p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"], -1.0, 1.0))


def slerp(p: Column, q: Column, t: Column) -> Column:
    w = arc(p, q)
    a, b = F.sin((1 - t) * w) / F.sin(w), F.sin(t * w) / F.sin(w)
    near = w < 1e-9
    return F.struct(*[F.when(near, p[k]).otherwise(p[k] * a + q[k] * b).alias(k) for k in ("x", "y", "z")])
