"""Numbers, labels and colours as they are shown, and the geometry of plots."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flag_list, polynomial_hash, unit_symbol


def half_down(c: Column, places: int) -> Column:
    """c, or what it rounds down to where the stored value is below the middle.

    Formatting rounds the shortest digits (1.005 up); what counts is the value (1.00499999999999989...).
    The error of c * 10^places is exact: both factors are split in halves (Dekker).
    """
    size, by = F.abs(c), 10.0**places
    product = size * by
    high = size * 134217729.0 - (size * 134217729.0 - size)
    low = size - high  # `by` has few bits: its own low half is 0
    error = (high * by - product) + low * by
    below = (product < 2.0**52) & ((product - F.floor(product) - 0.5) + error < 0)
    return F.when(below, F.signum(c) * F.floor(product) / by).otherwise(c)


def fixed(c: Column, places: int, trim: bool = False) -> Column:
    """`places` decimal places of the stored value; exact ties away from zero."""
    text = F.printf(F.lit(f"%.{places}f"), half_down(c, places))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if trim else text


def banded(c: Column, bands: list[tuple[float, int, bool]], last: tuple[int, bool]) -> Column:
    """Decimal places by size: (from, places, trimmed) from large to small, then the rest."""
    size, out = F.abs(c), F.when(c.isNull() | F.isnan(c), "")
    for least, places, trim in bands:
        out = out.when(size >= least, fixed(c, places, trim))
    return out.otherwise(fixed(c, *last))


def value_text(c: Column) -> Column:
    return banded(c, [(1000, 0, False), (100, 1, False), (10, 2, False)], (3, True))


def axis_text(c: Column) -> Column:
    return banded(c, [(1000, 0, False), (100, 1, True), (1, 2, True)], (3, True))


def load_text(c: Column) -> Column:
    """Six bands; very large numbers by powers of ten."""
    large = F.regexp_replace(F.printf(F.lit("%.2e"), c), r"e([+-])0*(\d)", "e$1$2")
    rest = banded(c, [(1000, 0, False), (100, 1, False), (10, 2, False), (1, 3, True)], (4, True))
    return F.when(c.isNull() | F.isnan(c), "0").when(F.abs(c) >= 10000, large).otherwise(rest)


def is_converted(flags: Column) -> Column:
    return F.exists(flag_list(flags), lambda f: f.startswith("unit_converted:"))


def metric_text(value: Column, unit: Column, flags: Column) -> Column:
    """Value, unit symbol, and a star if the unit was converted."""
    text = F.concat_ws(" ", F.nullif(value_text(value), F.lit("")), F.nullif(unit_symbol(unit), F.lit("")))
    return F.concat(text, F.when(is_converted(flags), "*").otherwise(""))


#: What a flag tells a reader.
NOTES = [
    ("impact_area_normalized", "Area-normalized Izod values are not directly comparable to linear ones."),
    ("source_label_mismatch:izod_label_iso179", "The label says Izod, the standard is a Charpy one; kept as Charpy."),
    ("impact_method_inferred:", "The impact property is inferred from method or unit."),
    ("impact_method_unit_mismatch:", "Impact method and unit are of different families."),
    ("unit_not_converted", "The source's unit could not be converted safely."),
]


def quality_notes(flags: Column, raw: Column, unit_raw: Column) -> Column:
    """Sentences about an observation's flags: its conversion first, then the others in order."""
    hit = F.get(F.filter(flag_list(flags), lambda f: f.startswith("unit_converted:")), F.lit(0))
    pair = F.split(F.substring_index(hit, ":", -1), "->")
    units = F.concat_ws(" to ", unit_symbol(pair[0]), unit_symbol(F.get(pair, F.lit(1))))
    told = F.concat_ws(" ", F.nullif(raw, F.lit("")), F.nullif(unit_symbol(F.coalesce(unit_raw, pair[0])), F.lit("")))
    source = F.when(told != "", F.concat(F.lit("Converted from source value "), told)).otherwise("Converted from source units")
    first = F.when(hit.isNotNull(), F.concat(source, F.lit(" ("), units, F.lit(") for metric comparison.")))

    def note(f: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for start, text in NOTES:
            out = out.when(f.startswith(start), text)
        return out

    return F.array_compact(F.concat(F.array(first), F.transform(flag_list(flags), note)))


#: Words left out of, or shortened in, a property's label.
SHORT = [
    (" / ", "/"), (" temperature", ""), (" strength", ""), ("Heat deflection / distortion", "HDT"), ("Nozzle / extruder", "Nozzle"),
    ("Bed / build plate", "Bed"), ("Density / specific gravity", "Density"), ("Elongation / strain", "Elongation"), ("Tensile / Young's modulus", "Modulus"),
]


def short_metric(label: Column) -> Column:
    """Each replacement once, at its first place."""
    out = F.coalesce(label, F.lit(""))
    for a, b in SHORT:
        out = F.regexp_replace(out, rf"^(.*?)\Q{a}\E", f"$1{b}")
    return out


def clipped(c: Column, most: int = 18) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("..."))).otherwise(c)


def status_text(c: Column) -> Column:
    return F.translate(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")), "_", " ")


def ticks(low: Column, high: Column, pixels: int, apart: int) -> Column:
    """3 to 12 even marks of an axis; none for an empty range."""
    n = max(3, min(12, math.floor(pixels / apart + 0.5) + 1))
    marks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / (n - 1))
    return F.when(high > low, marks).otherwise(F.array().cast("array<double>"))


def mixed(a: tuple, b: tuple, t: Column) -> Column:
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.concat(F.lit("rgb("), F.concat_ws(" ", *[F.floor(x + (y - x) * part + 0.5).cast("string") for x, y in zip(a, b)]), F.lit(")"))


#: Colours at a utilisation of 0, 0.55, 1 and 1.35.
STOPS = [(0.0, (121, 217, 157)), (0.55, (232, 196, 91)), (1.0, (240, 126, 121)), (1.35, (185, 70, 84))]


def util_color(util: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.35), util))
    (a, ca), (b, cb), (c, cc), (d, cd) = STOPS
    return F.when(v < b, mixed(ca, cb, (v - a) / (b - a))).when(v < c, mixed(cb, cc, (v - b) / (c - b))).otherwise(mixed(cc, cd, (v - c) / (d - c)))


def hue(name: Column) -> Column:
    """The hue and saturation of a name without a colour of its own."""
    h = polynomial_hash(F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")))
    return F.struct(F.floor(F.pmod(23 + h * 137.508, F.lit(360.0)) + 0.5).cast("int").alias("hue"), (52 + h % 24).cast("int").alias("sat"))


def radar_point(axis: Column, axes: int, norm: Column, radius: float) -> Column:
    """Where a normalised value lies on its spoke; spokes go clockwise from the top."""
    angle = axis * (2 * math.pi / axes) - math.pi / 2
    return F.struct((F.cos(angle) * norm * radius).alias("x"), (F.sin(angle) * norm * radius).alias("y"))


def source_links(page: Column, pdf: Column, local: Column, most: int = 3) -> Column:
    """(kind, address) of what is known, page before PDF before local file."""
    one = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(kind).alias("kind"), c.alias("href")))
    return F.slice(F.array_compact(F.array(one("Source page", page), one("Vendor PDF", pdf), one("Local datasheet", local))), 1, most)


def sag_scale(reach: Column, deflection: Column) -> Column:
    """How much a deformed shape is drawn enlarged: 8 to 180 times."""
    return F.greatest(F.lit(8.0), F.least(F.lit(180.0), reach / F.greatest(F.abs(deflection), F.lit(1e-9))))


def slice_layer(y: Column, low: Column, layer: float) -> Column:
    """Number and height of the printed layer at y."""
    k = F.greatest(F.lit(0), F.floor((y - low) / layer))
    return F.struct(k.cast("int").alias("layer"), (low + (k + 0.5) * layer).alias("y"))
