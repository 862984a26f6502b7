"""Elevation tiles: 24-bit heights in pixel colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_height(r: Column, g: Column, b: Column) -> Column:
    """Metres of a pixel; the middle value is no data."""
    v = r.cast("long") * 65536 + g.cast("long") * 256 + b.cast("long")
    return F.when(v < 8388608, v * 0.01).when(v > 8388608, (v - 16777216) * 0.01)
