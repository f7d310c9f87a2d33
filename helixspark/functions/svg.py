"""Lengths, sizes and colours of SVG markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels per unit at 96 per inch.
UNIT_PX = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "pt": 96.0 / 72.0, "pc": 96.0 / 6.0, "q": 96.0 / 25.4 / 4.0}
MAX_SIDE = 65535


def parse_length(text: Column) -> Column:
    """Struct ``px, unit, inches`` of a length; null if it has no number. Unknown units are pixels."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^([0-9.+\-eE]*)", 1)
    unit = F.lower(F.trim(F.regexp_extract(trimmed, r"(?s)^[0-9.+\-eE]*(.*)$", 1)))
    value = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double"))
    factor = F.lit(1.0)
    for name, px in UNIT_PX.items():
        factor = F.when(unit == name, F.lit(px)).otherwise(factor)
    px = value * factor
    return F.when(px.isNotNull(), F.struct(px.alias("px"), unit.alias("unit"), (px / 96.0).alias("inches")))


def svg_tag(markup: Column) -> Column:
    """From the first ``<svg`` to the first ``>`` after it; empty if there is none."""
    return F.regexp_extract(markup, r"(?is)(<svg[^>]*)>", 1)


def size_attribute(tag: Column, name: str) -> Column:
    """An attribute's value, double quotes before single; null if absent."""
    double = F.regexp_extract(tag, rf'(?is){name}="([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?is){name}='([^']*)'", 1)
    return F.when(tag.rlike(rf'(?is){name}="[^"]*"'), double).when(tag.rlike(rf"(?is){name}='[^']*'"), single)


def extract_svg_size(markup: Column) -> Column:
    """Struct ``width, height`` of the raw attribute texts."""
    tag = svg_tag(markup)
    return F.struct(size_attribute(tag, "width").alias("width"), size_attribute(tag, "height").alias("height"))


def parse_hex_color(text: Column) -> Column:
    """Struct ``r, g, b, a`` of RGB, RRGGBB or AARRGGBB after any number of ``#``; null for all else."""
    h = F.regexp_replace(F.trim(text), "^#+", "")
    valid = h.rlike("^([0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    full = F.when(F.length(h) == 3, F.concat(F.lit("FF"), F.regexp_replace(h, "(.)", "$1$1"))).when(F.length(h) == 6, F.concat(F.lit("FF"), h)).otherwise(h)

    def byte(k: int) -> Column:
        return F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")

    return F.when(valid, F.struct(byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"), byte(0).alias("a")))


def target_size(width: Column, height: Column, out_width: Column, out_height: Column, scale: Column, keep_physical: Column, dpi: Column, width_in: Column, height_in: Column) -> Column:
    """Struct ``w, h, sx, sy``: both sides given, one given, physical size at dpi, scale, in this order; sides are 1 to 65535."""
    wide, high = F.coalesce(out_width > 0, F.lit(False)), F.coalesce(out_height > 0, F.lit(False))
    physical = F.coalesce(keep_physical & (width_in > 0) & (height_in > 0), F.lit(False))
    scaled = F.abs(scale - 1) > 1e-9
    phys_w, phys_h = F.round(width_in * dpi), F.round(height_in * dpi)
    sx = F.when(wide, out_width / width).when(high, out_height / height).when(physical, phys_w / width).when(scaled, scale).otherwise(F.lit(1.0))
    sy = F.when(high & wide, out_height / height).when(wide, sx).when(high, sx).when(physical, phys_h / height).when(scaled, scale).otherwise(F.lit(1.0))
    w = F.when(wide, out_width).when(~high & physical, phys_w).otherwise(F.round(width * sx))
    h = F.when(high, out_height).when(~wide & physical, phys_h).otherwise(F.round(height * sy))

    def side(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1)), F.lit(MAX_SIDE)).cast("int")

    return F.struct(side(w).alias("w"), side(h).alias("h"), sx.cast("double").alias("sx"), sy.cast("double").alias("sy"))
