"""Text parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_footnotes(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\[.*?\]", ""))


def leading_integer(c: Column) -> Column:
    """The first digits of a text, thousands commas ignored; null without any."""
    found = F.regexp_extract(c, r"^\s*([\d,]+)", 1)
    return F.regexp_replace(found, ",", "").try_cast("long")


def lenient_number(c: Column) -> Column:
    """"12", "12.5 m" or "5,5"; null where there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"^\s*([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")


def truthy(c: Column) -> Column:
    """A number that counts as given: zero counts as missing."""
    return F.when(c != 0, c)


def slug(c: Column) -> Column:
    """Lower case, everything else a single dash; what follows an en dash is left out."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.split_part(c, F.lit("–"), F.lit(1))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def without_parenthesis(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def link_title(href: Column) -> Column:
    """The page a site link names: prefix and fragment taken off."""
    return F.split_part(F.regexp_replace(href, r"^/wiki/", ""), F.lit("#"), F.lit(1))


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def clock(seconds: Column) -> Column:
    """m:ss.s, halves to the even digit."""
    m = F.floor(seconds / 60)
    return F.format_string("%d:%04.1f", m.cast("long"), F.bround(seconds - m * 60, 1))


def points(c: Column) -> Column:
    """"x y z x y z ..." as array<struct<x,y,z>>."""
    v = F.transform(F.split(F.trim(c), r"\s+"), lambda s: s.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1), lambda i: F.struct(F.element_at(v, 3 * i + 1).alias("x"), F.element_at(v, 3 * i + 2).alias("y"), F.element_at(v, 3 * i + 3).alias("z")))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A template with {name} places."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


def hex_colour(c: Column) -> Column:
    """struct(r, g, b) in 0..1 of "#rrggbb"."""
    v = F.conv(F.substring(c, 2, 6), 16, 10).cast("long")
    part = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(255)) / 255.0
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def byte_of(v: Column) -> Column:
    """0..1 as 0..255, halves rounded up."""
    return F.floor(v * 255 + 0.5).cast("long")
