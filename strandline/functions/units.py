"""Units and numbers: what a value's unit is, conversion, and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One foot-pound-force per inch in joules per metre; a pound in kilograms.
FT_LB_PER_IN = 1.3558179483314004 / 0.0254
POUND_KG = 0.45359237
#: Fixed values: (from, to, factor); Fahrenheit is handled apart.
FACTORS = [
    ("GPa", "MPa", 1000.0), ("kPa", "MPa", 0.001), ("Pa", "MPa", 1e-6), ("psi", "MPa", 0.006894757), ("ksi", "MPa", 6.894757),
    ("kg/m3", "g/cm3", 0.001), ("g/cc", "g/cm3", 1.0), ("g", "kg", 0.001), ("J/m2", "kJ/m2", 0.001), ("ft-lb/in", "J/m", FT_LB_PER_IN),
]
#: A number, and a value: optional sign of inequality, number, spread, range end.
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
VALUE = rf"([<>~])?\s*({NUMBER})(?:\s*(?:±|\+/-)\s*({NUMBER}))?(?:\s*(?:-|to|–)\s*({NUMBER}))?"
IMPACT = ["impact_charpy", "impact_izod", "impact_izod_area", "impact_strength"]


def has_ft_lb_per_in(text: Column) -> Column:
    flat = F.translate(F.replace(F.lower(text), F.lit(" "), F.lit("")), "·*", "--")
    return flat.rlike(r"ft[-.]?lbf?/in")


def detect_unit(text: Column, canonical: Column, key: Column) -> Column:
    """The unit in a window of text, for a property with the given canonical unit; the first hit wins."""
    flat = F.lower(F.replace(F.translate(text, "³²", "32"), F.lit(" "), F.lit("")))
    has = lambda s: F.contains(flat, F.lit(s))
    heat = F.when(has("°f"), "degF").when(has("°c"), "degC").when(F.contains(text, F.lit("℉")) | text.rlike(r"(?i)\bf\b"), "degF").otherwise("degC")
    stress = (
        F.when(has("gpa"), "GPa").when(has("mpa"), "MPa").when(has("kpa"), "kPa").when(flat.rlike(r"\bpa\b"), "Pa")
        .when(has("ksi"), "ksi").when(has("psi"), "psi").otherwise("MPa")
    )
    area = F.when(has("j/m2") & ~has("kj/m2"), "J/m2").when(has("j/m") & ~has("kj/m"), "J/m").otherwise("kJ/m2")
    mass = F.when(text.rlike(r"(?i)\d\s*g\b") & ~text.rlike(r"(?i)\d\s*kg\b"), "g").otherwise("kg")
    return (
        F.when(key.isin(*IMPACT) & has_ft_lb_per_in(text), "ft-lb/in")
        .when(canonical == "degC", heat)
        .when(canonical == "MPa", stress)
        .when(canonical == "g/cm3", F.when(has("kg/m3"), "kg/m3").when(has("g/cc"), "g/cc").otherwise("g/cm3"))
        .when(canonical == "kJ/m2", area)
        .when(canonical == "J/m", F.when(has("kj/m2"), "kJ/m2").when(has("j/m2"), "J/m2").otherwise("J/m"))
        .when(canonical == "kg", mass)
        .otherwise(canonical)
    )


def factor(unit: Column, to: Column) -> Column:
    """What to multiply by on the way from one unit to another; null if there is no such way."""
    known = F.create_map(*[x for a, b, f in FACTORS for x in (F.lit(f"{a}->{b}"), F.lit(f))])
    return F.when(unit == to, F.lit(1.0)).otherwise(F.try_element_at(known, F.concat(unit, F.lit("->"), to)))


def convert(value: Column, unit: Column, to: Column) -> Column:
    """The value in another unit; null if there is no way."""
    return F.when((unit == "degF") & (to == "degC"), (value - 32) * 5 / 9).otherwise(value * factor(unit, to))


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def parse_numeric(raw: Column, unit: Column, canonical: Column) -> Column:
    """(lo, hi, nominal, flags): scalar, range with its midpoint, or value and spread, converted where possible."""
    text = F.translate(raw, ",", ".")
    part = lambda k: F.regexp_extract(text, rf"(?i){VALUE}", k)
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("double")
    heat = (unit == "degF") & (canonical == "degC")
    told = F.struct(
        part(1).alias("sign"), number(2).alias("a"), number(3).alias("pm"), number(4).alias("b"), unit.alias("unit"), canonical.alias("to"),
        heat.alias("heat"), factor(unit, canonical).alias("f"),
    )

    def made(t: Column) -> Column:
        fits = t["heat"] | t["f"].isNotNull()
        to = lambda v: F.when(t["heat"], (v - 32) * 5 / 9).otherwise(v * F.coalesce(t["f"], F.lit(1.0)))
        lo = F.when(t["pm"].isNotNull(), t["a"] - t["pm"]).when(t["b"].isNotNull(), F.least(t["a"], t["b"])).otherwise(t["a"])
        hi = F.when(t["pm"].isNotNull(), t["a"] + t["pm"]).when(t["b"].isNotNull(), F.greatest(t["a"], t["b"])).otherwise(t["a"])
        mid = F.when(t["pm"].isNull() & t["b"].isNotNull(), (t["a"] + t["b"]) / 2).otherwise(t["a"])
        some = t["a"].isNotNull()
        flags = F.concat_ws(
            ";",
            F.when(~some, "non_numeric"),
            F.when(some & (t["sign"] != ""), F.concat(F.lit("inequality:"), t["sign"])),
            F.when(some & ~fits, "unit_not_converted"),
            F.when(some & fits & (t["unit"] != t["to"]), F.concat(F.lit("unit_converted:"), t["unit"], F.lit("->"), t["to"])),
        )
        return F.struct(to(lo).alias("lo"), to(hi).alias("hi"), to(mid).alias("nominal"), flags.alias("flags"))

    return bound(told, made)


def number_or_none(c: Column) -> Column:
    """The first number of a text without its commas, if over 0 and under 10000."""
    return in_bounds(first_number(c))


def number_once(c: Column) -> Column:
    """number_or_none inside a lambda, where Spark works a repeated expression out each time."""
    return bound(first_number(c), in_bounds)


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0).try_cast("double")


def in_bounds(n: Column) -> Column:
    return F.when((n > 0) & (n < 10000), n)


def positive_or(c: Column, fallback: Column | float) -> Column:
    """A number over 0, else the fallback."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n).otherwise(fallback)


def is_major(c: Column, step: int = 10) -> Column:
    """Whether a grid line is one of each `step`, up to rounding."""
    return F.abs(c / step - F.round(c / step)) < 1e-6


def iso_day(stamp: Column) -> Column:
    """The date of a timestamp or of its ISO text, as text."""
    return F.substring(F.coalesce(stamp.cast("string"), F.lit("")), 1, 10)


def mass_kg(amount: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.isin("g", "gram", "grams"), amount / 1000).when(u.rlike("^(lb|pound)"), amount * POUND_KG).otherwise(amount)


def shop_price(price: Column, in_cents: Column) -> Column:
    """A shop's price in whole units: cents if said so, or if too large to be a price."""
    return F.when(in_cents | (price > 200), price / 100).otherwise(price)


def mass_candidates(text: Column) -> Column:
    """Masses in a text as an array of (kg, raw): multipacks, then single ones; 0.05 to 25 kg, no minimum orders."""
    num = r"(?:\d+(?:[.,]\d+)?|[.,]\d+)"
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))
    orders = ("moq", "minimum order", "min order")  # a mass within 16 characters of these is none
    clear = r"(?=[\d.,])" + "".join(rf"(?<!\b{w}\b.{{0,{16 - len(w)}}})" for w in orders)  # looks back only where a number begins
    calm = "".join(rf"(?!.{{0,{16 - len(w)}}}\b{w}\b)" for w in orders)
    packs = F.regexp_extract_all(low, F.lit(rf"{clear}\b{num}\s*[x×]\s*{num}\s*(?:kg|g|lbs?|pounds?)\b{calm}"), F.lit(0))
    singles = F.regexp_extract_all(low, F.lit(rf"{clear}(?<![\w.]){num}\s*(?:kgs?|kilograms?|g|grams?|lbs?|pounds?)\b{calm}"), F.lit(0))
    value = lambda s, pattern, k: F.translate(F.regexp_extract(s, pattern, k), ",", ".").try_cast("double")
    pack = rf"^({num})\s*[x×]\s*({num})\s*([a-z]+)$"
    single = rf"^({num})\s*([a-z]+)$"
    made = F.concat(
        F.transform(packs, lambda s: F.struct(mass_kg(value(s, pack, 1) * value(s, pack, 2), F.regexp_extract(s, pack, 3)).alias("kg"), s.alias("raw"))),
        F.transform(singles, lambda s: F.struct(mass_kg(value(s, single, 1), F.regexp_extract(s, single, 2)).alias("kg"), s.alias("raw"))),
    )
    return F.filter(made, lambda m: (m["kg"] >= 0.05) & (m["kg"] <= 25))


#: Fixed value: every mass has a digit before what may begin a unit or a factor; texts without hold none.
MAYBE_MASS = r"(?Ui)\d\s*[kglpx×]"


def largest_mass(text: Column, finish=lambda m: m) -> Column:
    """The largest of a text's masses, the first of equal ones, as finish((kg, raw)); null if none."""
    return F.when(text.rlike(MAYBE_MASS), largest(mass_candidates(text), finish))


def largest(found: Column, finish=lambda m: m) -> Column:
    """The largest mass of an array, the first of equal ones."""
    return F.aggregate(
        found, F.lit(None).cast("struct<kg: double, raw: string>"), lambda best, m: F.when(best.isNull() | (m["kg"] > best["kg"]), m).otherwise(best), finish
    )
