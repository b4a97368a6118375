"""Classes read off text: material, orientation, condition, method, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_spaces, squeeze

#: Material tokens, looked for in this order anywhere in the name.
TOKENS = [
    "PLA-CF", "PETG-CF", "PA6-CF", "PA12-CF", "PA612-CF", "PC-ABS", "PC ABS", "PCASA", "PC-ASA", "ABS-GF", "ASA-CF", "PET-CF", "PPA-CF",
    "PPS-CF", "TPU", "PETG", "PCTG", "PLA", "ABS", "ASA", "HIPS", "PAHT", "PA6", "PA12", "PA11", "NYLON", "PA", "PC", "PEEK", "PEKK", "PEI",
    "ULTEM", "PPSU", "PPS", "PSU", "PVDF", "PVA", "PVB", "PHA", "PP", "CPE",
]
#: Words in a name and the modifier they stand for.
MODIFIERS = [
    ("MATTE", "Matte"), ("BASIC", "Basic"), ("SILK", "Silk"), ("WOOD", "Wood"), ("STONEFILL", "Stone"), ("BRONZEFILL", "Metal"),
    ("COPPERFILL", "Metal"), ("STEELFILL", "Metal"), ("LIGHT WEIGHT", "Lightweight"), ("CF", "Carbon fiber"), ("CARBON", "Carbon fiber"),
    ("GF", "Glass fiber"), ("GLASS", "Glass fiber"), ("ESD", "ESD"), ("AERO", "Aero"), ("GLOW", "Glow"), ("MARBLE", "Marble"),
    ("METAL", "Metal"), ("RECYCLED", "Recycled"), ("TOUGH", "Tough"), ("HIGH SPEED", "High speed"), ("HS", "High speed"), ("PRO", "Pro"),
    ("MAX", "Max"), ("FLEX", "Flexible"), ("SUPPORT", "Support"), ("TRANSLUCENT", "Translucent"), ("TRANSPARENT", "Transparent"),
    ("FIRE", "Flame retardant"), ("FR", "Flame retardant"),
]
#: Modifiers that don't take part in a family's name.
UNSIGNED = ["Stone", "Lightweight", "Max"]
#: Names that say all by themselves.
SPECIAL = [(r"COLORFABB[_ ]XT", "colorFabb_XT", []), (r"COLORFABB[_ ]HT", "colorFabb_HT", []), (r"XT[- ]CF20", "XT-CF20", ["Carbon fiber"])]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def classify_material(product: Column) -> Column:
    """(base, family, modifiers) of a product name."""
    up = F.upper(F.translate(F.coalesce(product, F.lit("")), "™®", ""))
    hit = F.get(F.filter(strings(TOKENS), lambda t: F.contains(up, t)), F.lit(0))
    full = F.coalesce(F.when(hit == "NYLON", "PA").otherwise(hit), F.lit("Unknown"))
    base = (
        F.when(full.isin("PCASA", "PC ABS"), "PC").when(full == "ULTEM", "PEI").otherwise(F.get(F.split(full, "-"), F.lit(0)))
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in MODIFIERS])
    tags = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(up, p["n"])), lambda p: p["t"]))
    signed = F.filter(tags, lambda t: ~t.isin(*UNSIGNED))

    def join(family: Column, tag: Column) -> Column:
        told = F.contains(F.upper(family), F.upper(tag))
        fibre = ((tag == "Carbon fiber") & family.rlike("CF|CARBON")) | ((tag == "Glass fiber") & family.rlike("GF|GLASS"))
        return F.when(told | fibre, family).otherwise(F.concat_ws(" ", family, tag))

    out = F.struct(base.alias("base"), F.aggregate(signed, full, join).alias("family"), tags.alias("modifiers"))
    for pattern, family, own in reversed(SPECIAL):
        fixed = F.struct(F.lit("CPE").alias("base"), F.lit(family).alias("family"), strings(own).alias("modifiers"))
        out = F.when(up.rlike(pattern), fixed).otherwise(out)
    return out


def orientation(text: Column) -> Column:
    """The first of X-Y, XY, YZ, Z, HORIZONTAL, VERTICAL as words, then flat, side, up."""
    up = F.upper(text)
    out = F.when(F.lit(False), F.lit(""))
    for word in ("X-Y", "XY", "YZ", "Z", "HORIZONTAL", "VERTICAL"):
        out = out.when(up.rlike(rf"(?U)\b{word}\b"), word)
    return out.when(F.contains(up, F.lit("FLAT")), "flat").when(F.contains(up, F.lit("SIDE")), "side").when(up.rlike(r"(?U)\bUP\b"), "up")


#: Words of a test's condition, in the order they are named.
CONDITIONS = ["dry", "wet", "annealed", "dried", "conditioned", "unnotched", "notched", "yield", "break"]


def condition(text: Column) -> Column:
    """Condition words and loads found, joined by commas; null if none."""
    low = F.lower(text)
    bits = [F.when(low.rlike(rf"(?U)(?<!un)\b{w}\b"), w) for w in CONDITIONS]
    bits.append(F.when(low.rlike(r"0[.,]45"), "0.45 MPa load"))
    bits.append(F.when(low.rlike(r"1[.,]8"), "1.8 MPa load"))
    return F.nullif(F.array_join(F.array_compact(F.array(*bits)), ", "), F.lit(""))


def method(text: Column) -> Column:
    """The first standard's name in a text, upper-cased; else DSC or TGA."""
    code = F.regexp_extract(text, r"(?i)\b(?:ISO|ASTM|GB/T|IEC|DIN|UL)\s*[-/]?\s*[A-Z]?\s*\d+(?:[-/]\d+)?(?:\s*/\s*[A-Z0-9]+)?", 0)
    return F.when(code != "", F.upper(compact_spaces(code))).when(text.rlike(r"(?i)\bDSC\b"), "DSC").when(text.rlike(r"(?i)\bTGA\b"), "TGA")


def linear_izod_method(text: Column) -> Column:
    return F.nullif(F.upper(compact_spaces(F.regexp_extract(text, r"(?i)\bASTM\s*D\s*(?:256|4812)\b", 0))), F.lit(""))


def impact_method(text: Column) -> Column:
    """charpy_area, iso_izod_area or astm_izod_linear by the standard named."""
    return (
        F.when(text.rlike(r"(?i)\bISO\s*[-/]?\s*179\b|\bASTM\s*D\s*6110\b"), "charpy_area")
        .when(text.rlike(r"(?i)\bISO\s*[-/]?\s*180\b"), "iso_izod_area")
        .when(text.rlike(r"(?i)\bASTM\s*D\s*(?:256|4812)\b"), "astm_izod_linear")
    )


def impact_unit(unit: Column) -> Column:
    return F.when(unit.isin("kJ/m2", "J/m2"), "area").when(unit.isin("J/m", "ft-lb/in"), "linear")


#: Labels of specification rows and the patterns that mean them; the first wins.
LABELS = [
    ("Diameter Tolerance", r"dimensional accuracy|diameter tolerance|filament tolerance|\btolerance\b"),
    ("Diameter", r"filament diameter|\bdiameter\b"),
    ("Net Weight", r"net (?:filament )?weight|filament weight|spool net weight|\bweight\b"),
    ("Filament Length", r"filament length|line length"),
    ("Nozzle Temperature", r"nozzle temperature|printing temperature|print temperature|extrusion temperature|extruder temperature"),
    ("Bed Temperature", r"bed temperature|build plate temperature|heated bed|hot bed"),
    ("Print Speed", r"print speed|printing speed"),
    ("Density", r"specific gravity|\bdensity\b"),
    ("Melt Flow Index", r"melt flow index|melt flow rate|melt index|\bmfr\b|\bmfi\b"),
    ("Tensile Strength", r"tensile strength|tensile stress"),
    ("Tensile Modulus", r"tensile modulus|young'?s modulus"),
    ("Elongation", r"elongation at break|breaking elongation|\belongation\b"),
    ("Flexural Strength", r"flexural strength|bending strength"),
    ("Flexural Modulus", r"flexural modulus|bending modulus"),
    ("Charpy Impact Strength", r"charpy"),
    ("Izod Impact Strength", r"izod"),
    ("Impact Strength", r"impact strength"),
    ("Hardness Shore D", r"shore d|shore hardness d"),
    ("Hardness Shore A", r"shore a|shore hardness a"),
    ("Heat Distortion Temperature", r"heat distortion|heat deflection|thermal deformation|\bhdt\b"),
    ("Vicat Softening Temperature", r"vicat"),
    ("Glass Transition Temperature", r"glass transition|\btg\b"),
    ("Melting Temperature", r"melting point|melting temperature|\btm\b"),
    ("Water Absorption", r"water absorption|moisture absorption"),
    ("Shrinkage", r"shrinkage"),
]
#: Labels that never name a property.
NO_LABEL = r"price|sku|barcode|review|warranty|brand|color|proposition|warning|inner diameter|outer diameter"


#: What page_space changes has at least one of these; other texts it leaves as they are.
ODD = r"[^ -}]|  |\A | \z|m /|m/s\.|g /"


def page_space(c: Column) -> Column:
    """White space and signs of web pages, made alike."""
    from .text import replaced

    pairs = [
        (" ", " "), ("±", "+/-"), ("−", "-"), ("–", "-"), ("—", "-"), ("∼", "~"), ("～", "~"), ("℃", " C"),
        ("°C", " C"), ("°F", " F"), ("mm / s", "mm/s"), ("mm /sec", "mm/s"), ("mm/s.", "mm/s"), ("g / cm3", "g/cm3"),
        ("g/cm³", "g/cm3"), ("g / 10 min", "g/10min"),
    ]
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(ODD), squeeze(F.regexp_replace(replaced(text, pairs), r"(?<=\d)\s*~\s*(?=\d)", "-"))).otherwise(text)


def canonical_label(label: Column) -> Column:
    """The property a row's label means, or null."""
    low = F.lower(page_space(label))
    net = F.contains(low, F.lit("net"))
    none = (low == "") | (F.length(low) > 90) | low.rlike(NO_LABEL) | (low.rlike("package|gross|carton|shipping|spool weight") & ~net)
    out = F.when(none, F.lit(None).cast("string"))
    for name, pattern in LABELS:
        out = out.when(low.rlike(pattern), name)
    return out


def looks_like_value(value: Column) -> Column:
    v = page_space(value)
    low = F.lower(v)
    bad = low.rlike("proposition|warning|warranty|shipping|delivery|refund|return|discount|coupon|sold out") | v.rlike(r"[$]\s*\d")
    digit = F.regexp_replace(low, r"\b3d\b", "").rlike(r"\d") | v.rlike(r"(?i)\b(HB|V-0|V-1|V-2|Shore)\b")
    return (v != "") & (F.length(v) <= 160) & ~bad & digit


def normalize_value(label: Column, value: Column) -> Column:
    """The value with the unit its label names in brackets, if it has none, and units spaced."""
    hint = page_space(F.regexp_extract(label, r"\(([^)]+)\)", 1))
    known = hint.rlike(r"(?i)^(MPa|GPa|kPa|Pa|psi|ksi|mm|m|kg|g|%|g/cm3|g/10min|mm/s|C|F)$")
    v = page_space(value)
    has = v.rlike(r"(?i)MPa|GPa|kPa|Pa|psi|ksi|mm/s|mm3/s|mm|kg|g\b|%|g/cm|g/cc|g/10|min| C\b| F\b|Shore")
    v = F.when(known & ~has, F.concat_ws(" ", v, hint)).otherwise(v)
    v = F.regexp_replace(v, r"(?i)(?<=\d)\s*/\s*10\s*min", "/10min")
    return page_space(F.regexp_replace(F.regexp_replace(v, r"(?<=\d)\s*C\b", " C"), r"(?<=\d)\s*F\b", " F"))
