"""Camera curves as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspan.functions.coords import clip

#: Path constants (fixed values): zoom against pan, margin, base time, time a unit, bounds of the time.
RHO, MARGIN, BASE_MS, UNIT_MS, MIN_MS, MAX_MS = 1.4, 1.2, 600.0, 430.0, 650.0, 4200.0
#: Half the visible height in metres at zoom 1.
HALF_HEIGHT = 64.0


def smoothstep(t: Column) -> Column:
    c = clip(t, 0.0, 1.0)
    return c * c * (3 - 2 * c)


def ease_in_out(t: Column) -> Column:
    """Cubic, slow at both ends."""
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3.0)) / 2)


def detail_scale(u: Column) -> Column:
    """How much wider cubes may be in flight: 3, easing back to 1 at the end."""
    return 3 - 2 * smoothstep((u - 0.6) / 0.32)


def pixels_per_metre(view_height: Column, zoom: Column) -> Column:
    return view_height / (2 * HALF_HEIGHT / zoom)


def eye_height(ground: Column, fallback: Column) -> Column:
    return F.when(ground.isNull(), fallback).otherwise(0.6 * ground + 8)


def screen_reach(dx: Column, dz: Column, azimuth: Column, polar: Column, aspect: Column) -> Column:
    sx = dx * F.cos(azimuth) - dz * F.sin(azimuth)
    sy = (-dx * F.sin(azimuth) - dz * F.cos(azimuth)) * F.cos(polar)
    return F.greatest(F.abs(sx), F.abs(sy) * aspect)


def flight(w0: Column, w1: Column, reach: Column) -> Column:
    """struct(zoom_only, length, r0) of the optimal pan-and-zoom path (van Wijk and Nuij 2003)."""
    u = F.greatest(reach, F.lit(1e-12))
    r2, r4 = RHO * RHO, RHO**4
    only = reach < 1e-3 * F.least(w0, w1)
    b0 = (w1 * w1 - w0 * w0 + r4 * u * u) / (2 * w0 * r2 * u)
    b1 = (w1 * w1 - w0 * w0 - r4 * u * u) / (2 * w1 * r2 * u)
    r0, r1 = F.asinh(-b0), F.asinh(-b1)
    return F.struct(only.alias("zoom_only"), F.when(only, F.abs(F.ln(w1 / w0)) / RHO).otherwise((r1 - r0) / RHO).alias("length"), F.when(only, 0.0).otherwise(r0).alias("r0"))


def flight_ms(length: Column) -> Column:
    return clip(BASE_MS + UNIT_MS * length, MIN_MS, MAX_MS)


def flight_at(plan: Column, w0: Column, w1: Column, reach: Column, s: Column) -> Column:
    """struct(frac, width) after path length s."""
    r0 = plan["r0"]
    frac = clip((w0 / (RHO * RHO)) * (F.cosh(r0) * F.tanh(RHO * s + r0) - F.sinh(r0)) / F.greatest(reach, F.lit(1e-12)), 0.0, 1.0)
    width = w0 * F.cosh(r0) / F.cosh(RHO * s + r0)
    alone = F.when(plan["length"] > 0, s / plan["length"]).otherwise(1.0)
    return F.struct(F.when(plan["zoom_only"], alone).otherwise(frac).alias("frac"), F.when(plan["zoom_only"], w0 * F.exp(F.signum(w1 - w0) * RHO * s)).otherwise(width).alias("width"))
