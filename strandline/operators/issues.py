"""Issue rules over observations, and what happens to their findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import classify as C
from ..functions import text as X
from .repeats import once_each
from .stats import first_wins

CONFIDENCES = ["high", "medium", "uncertain"]


def evaluate(obs: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One row for every rule that holds on an observation: all rules are tried in one pass."""
    hits = [F.when(c, F.struct(F.lit(conf).alias("confidence"), F.lit(kind).alias("issue_type"))) for conf, kind, c in rules]
    return obs.withColumn("__hit", F.explode(F.array_compact(F.array(*hits)))).select("*", "__hit.*").drop("__hit")


def issue_id(confidence: Column, parts: Sequence[Column]) -> Column:
    """The confidence's letter and twelve digits of a digest of what tells issues apart."""
    text = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.upper(F.substring(confidence, 1, 1)), F.lit("-"), F.substring(F.sha1(text), 1, 12))


def suppress_by_high(issues: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lesser issues go where the same observation has one of high confidence."""
    sure = F.max((F.col("confidence") == "high").cast("int")).over(W.partitionBy(*key)) == 1
    return issues.withColumn("__sure", sure).where((F.col("confidence") == "high") | ~F.col("__sure")).drop("__sure")


def suppress_pairs(issues: DataFrame, key: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(gone, by): an issue of type `gone` goes where the same observation has one of type `by`."""
    w = W.partitionBy(*key)
    out = issues
    for i, (_, by) in enumerate(pairs):
        out = out.withColumn(f"__by{i}", F.max((F.col("issue_type") == by).cast("int")).over(w) == 1)
    for i, (gone, _) in enumerate(pairs):
        out = out.where(~((F.col("issue_type") == gone) & F.col(f"__by{i}"))).drop(f"__by{i}")
    return out


def counts(issues: DataFrame) -> DataFrame:
    """Issues and records by confidence, and by confidence and type, in one pass over grouping sets."""
    return issues.groupingSets([["confidence"], ["confidence", "issue_type"]], "confidence", "issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("material_id").alias("materials")
    )


def confidence_rank(c: Column) -> Column:
    return F.array_position(C.strings(CONFIDENCES), c)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(confidence_rank(F.col("confidence")), "issue_type", "supplier", "product", "property_key", "raw_value")


#: Standards whose number gets read as a value.
CODES = {
    "527": "ISO 527", "178": "ISO 178", "179": "ISO 179", "306": "ISO 306", "306.10": "ISO 306 / 10N", "1183": "ISO 1183", "257": "ASTM D257",
    "638": "ASTM D638", "790": "ASTM D790",
}
#: What a cell's label names, in the order tried.
HINTS = [
    ("diameter_tolerance", r"diameter\s+tolerance|tolerance"), ("diameter", r"\bdiameter\b"),
    ("net_weight", r"net\s+(?:filament\s+)?weight|spool\s+weight"), ("filament_length", r"filament\s+length"),
    ("nozzle_temperature", r"nozzle|extrusion|extruder|print\s+temperature"), ("bed_temperature", r"\bbed\b|build\s+(?:plate|platform)"),
    ("chamber_temperature", r"chamber"), ("drying_temperature", r"dry(?:ing)?\s+(?:environment|temperature|temp)"),
    ("annealing_temperature", r"anneal"), ("print_speed", r"print(?:ing)?\s+speed"),
    ("density", r"(?<!infill\s)\bdensity\b|specific\s+gravity"), ("melt_flow_index", r"melt\s+(?:flow|index)|\bMFI\b|\bMFR\b"),
    ("melt_volume_rate", r"\bMVR\b|melt\s+volume"), ("water_absorption", r"water|moisture\s+absorption"), ("shrinkage", r"shrinkage"),
    ("tensile_strength", r"tensile\s+(?:yield\s+)?(?:strength|stress)"), ("tensile_modulus", r"(?:young'?s|tensile)\s+modulus"),
    ("elongation", r"elongation|strain"), ("flexural_strength", r"(?:flexural|bending)\s+strength"),
    ("flexural_modulus", r"(?:flexural|bending)\s+modulus"), ("impact", r"(?:charpy|izod|impact)\s+(?:strength|impact)"),
    ("hardness", r"hardness|shore"), ("hdt", r"heat\s+(?:deflection|distortion)|\bHDT\b|deflection\s+temperature"), ("vicat", r"vicat|vicar|VST"),
    ("glass_transition", r"glass\s+transition|\bTg\b"), ("melting_temperature", r"melting|melt\s+temperature"),
    ("crystallization_temperature", r"crystallization"), ("surface_resistance", r"surface\s+resist"), ("insulation_resistance", r"insulation\s+resist"),
    ("flame_retardancy", r"flame\s+retard|flammability"), ("chemical_resistance", r"chemical\s+resistance|effect\s+of"),
]
IMPACTS = ["impact_charpy", "impact_izod", "impact_strength"]
STRENGTHS = ["tensile_strength", "tensile_modulus", "flexural_strength", "flexural_modulus"]
MODULI = ["tensile_modulus", "flexural_modulus"]


def hint_of(cell: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, pattern in HINTS:
        out = out.when(cell.rlike(f"(?i){pattern}"), key)
    return out


def source_orientation(cell: Column) -> Column:
    """The orientation a label names: Z, YZ or X-Y, in this order."""
    up = F.upper(F.coalesce(cell, F.lit("")))
    return F.when(up.rlike(r"\bZ\b"), "Z").when(up.rlike(r"\(Y[- ]?Z\)|\bYZ\b"), "YZ").when(up.rlike(r"\bX[- ]?Y\b"), "X-Y")


def method_near(parts: Column, at: Column) -> Column:
    """The last standard named in the value's cell or the four before it."""
    start = F.greatest(at - 4, F.lit(0))
    text = F.array_join(F.slice(parts, start + 1, at - start + 1), " | ")
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:ISO|ASTM|GB/T|IEC|DIN|UL)\s*[-/]?\s*[A-Z]?\s*\d+(?:[-/]\d+)?"), F.lit(0))
    return F.when(at.isNotNull() & (F.size(found) > 0), F.upper(X.squeeze(F.element_at(found, -1))))


#: The columns that text_features reads, and about how many bytes it adds to them.
TEXTS, FEATURE_BYTES = ["raw_value", "source_context"], 4000


def context_features(obs: DataFrame) -> DataFrame:
    """obs, which is read twice, with its text_features."""
    return once_each(obs, TEXTS, text_features, FEATURE_BYTES, "left")


def text_features(obs: DataFrame) -> DataFrame:
    """Where the raw value stands among its context's cells, and the nearest label before it."""
    raw = X.squeeze(F.col("raw_value"))
    parts = X.cells(F.col("source_context"))
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    out = obs.withColumns({"raw": raw, "plain_raw": F.regexp_replace(F.translate(raw, ",", "."), r"^[<>~\s]+", ""), "ctx": X.squeeze(F.col("source_context")), "parts": parts})
    holds = lambda c: F.contains(c, F.col("raw")) | F.contains(F.replace(c, F.lit(" "), F.lit("")), bare)
    at = F.get(F.filter(F.transform("parts", lambda c, i: F.when((F.col("raw") != "") & holds(c), i)), lambda i: i.isNotNull()), F.lit(0))
    out = out.withColumn("raw_at", at).withColumn("hints", F.transform("parts", hint_of))
    label_at = F.array_max(F.filter(F.transform("hints", lambda h, i: F.when(h.isNotNull() & (i <= F.col("raw_at")), i)), lambda i: i.isNotNull()))
    out = out.withColumn("label_at", label_at)
    start = F.greatest(F.coalesce("raw_at", F.lit(0)) - 3, F.lit(0))
    near = F.array_join(F.slice("parts", start + 1, F.coalesce("raw_at", F.lit(0)) + 2 - start), " | ")
    return out.withColumns({"label_hint": F.get("hints", F.col("label_at")), "label_cell": F.coalesce(F.get("parts", F.col("label_at")), F.lit("")), "near": F.lower(near), "low": F.lower("ctx")})


def rules() -> list[tuple[str, str, Column]]:
    """All rules as (confidence, type, predicate) over context_features; where one excludes another it says so.

    Fixed values: the limits, words and patterns in the predicates, and the types' names.
    """
    key, value, raw, low, near = (F.col(c) for c in ("property_key", "value_nominal", "plain_raw", "low", "near"))
    has = lambda *words: F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in words])
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), raw)
    flat = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    coded = code.isNotNull() & (F.contains(flat(F.col("ctx")), flat(code)) | F.contains(flat(F.col("test_method")), flat(code)))
    ohm = key.isin("surface_resistance", "insulation_resistance")
    power = F.col("raw").rlike(r"(?:[<>]=?\s*)?10\d{2}(?:\s*-\s*10\d{2})?") | F.col("ctx").rlike(r"(?i)[x×]\s*10\d+")
    standard = raw.isin("257", "1183")
    small = F.coalesce(value <= 2, F.lit(False)) & has("mpa", "resistivity")
    advert = has("printing filament") | F.contains("raw", F.lit("160-300"))
    one_to_five = raw.rlike(r"^[1-5](?:\.0+)?$")
    hint = F.col("label_hint")
    own = (hint == key) | ((hint == "impact") & key.isin(*IMPACTS)) | ((hint == "hardness") & key.startswith("hardness_shore"))
    other_unit = (
        (F.contains(near, F.lit("%")) & (key != "elongation")) | F.contains(near, F.lit("kj/m")) | F.contains(near, F.lit("g/cm"))
        | (F.contains(near, F.lit("mpa")) & (key == "elongation"))
    )
    loads = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("0.45 mpa load")) | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("1.8 mpa load"))
    flexible = F.concat_ws(" ", "supplier", "product", "base_material", "material_family").rlike(r"(?i)\b(TPU|TPE|PEBA|flex|varioshore|shore\s*a)\b")
    oriented = source_orientation(F.col("label_cell"))
    impact = key.isin(*IMPACTS)
    table = [
        ("high", "test_method_code_captured_as_property_value", coded),
        ("high", "electrical_power_notation_flattened", ohm & power),
        ("high", "electrical_test_or_density_standard_captured", ohm & ~power & standard),
        ("high", "electrical_value_captured_from_neighboring_field", ohm & ~power & ~standard & small),
        ("high", "electrical_property_captured_from_commercial_text", ohm & ~power & ~standard & ~small & advert),
        ("high", "infill_density_captured_as_material_density", (key == "density") & has("infill density")),
        ("high", "document_version_captured_as_impact_value", impact & has("version: 3.0") & raw.rlike(r"^3(?:\.0+)?$")),
        ("high", "not_applicable_impact_row_published_as_number", impact & has("not applicable", "no break") & one_to_five),
        ("high", "impact_footnote_marker_captured_as_value", impact & F.col("ctx").rlike(r"(?i)\[[^\]]*kJ/m\s*2[^\]]*\]\s*\(\d+\)") & one_to_five),
        ("high", "neighboring_property_value_captured", key.isin(*STRENGTHS, "elongation") & hint.isNotNull() & ~own & other_unit),
        ("high", "test_speed_captured_as_mechanical_property", key.isin(*STRENGTHS) & (value <= 5) & near.rlike(r"mm ?/ ?min")),
        ("high", "print_speed_captured_from_multiplier_or_diameter", (key == "print_speed") & (value < 5) & (has("extrusion multiplier", "diameter") | F.contains(raw, F.lit("1.75")))),
        ("high", "nozzle_temperature_captured_from_print_speed", (key == "nozzle_temperature") & (value < 150) & (has("print speed") | F.contains("raw", F.lit("40-250")))),
        ("high", "chamber_temperature_captured_from_note_number", (key == "chamber_temperature") & (value < 20)),
        ("high", "annealing_temperature_captured_from_neighboring_print_setting", (key == "annealing_temperature") & (value > 200) & (hint != key)),
        ("high", "mfi_test_temperature_captured_as_flow_value", (key == "melt_flow_index") & (value > 150) & has("°c", "℃", "kg")),
        ("high", "filament_diameter_captured_as_length", (key == "filament_length") & (value < 10) & has("1.75mm") & low.rlike(r"\b3[0-9]{2}\s*-\s*3[0-9]{2}\s*m")),
        ("high", "thousands_separator_parsed_as_decimal", key.isin(*MODULI) & (value < 100) & F.col("raw").rlike(r"^\d{1,2}\.\d{3}$") & F.contains("ctx", F.translate("raw", ".", ","))),
        ("high", "vicat_method_and_load_captured_as_temperature", (key == "vicat") & raw.isin("306", "306.10")),
        ("medium", "impact_method_unit_semantics_ambiguous", key.isin("impact_izod", "impact_strength") & F.lower("unit_raw").isin("kj/m2", "kj/m²")),
        ("medium", "hdt_load_condition_bleeds_into_other_property", (key != "hdt") & loads(F.col("ctx")) & loads(F.col("condition"))),
        ("medium", "orientation_metadata_mismatch", oriented.isNotNull() & (F.coalesce("orientation", F.lit("")) != "") & (oriented != F.col("orientation"))),
        ("uncertain", "high_elongation_outlier_for_rigid_material", (key == "elongation") & (value > 100) & ~flexible & code.isNull()),
        ("uncertain", "very_low_modulus_outlier_for_rigid_material", key.isin(*MODULI) & (value > 0) & (value < 100) & ~flexible),
    ]
    return [(c, k, F.coalesce(p, F.lit(False))) for c, k, p in table]


#: An issue of the first type goes beside one of the second.
SUPPRESSED = [
    ("electrical_test_or_density_standard_captured", "test_method_code_captured_as_property_value"),
    ("test_method_code_captured_as_property_value", "vicat_method_and_load_captured_as_temperature"),
]
#: What makes two issues one observation's: file, product, key, raw value and the context's beginning.
CONTEXT_KEY = 240
ID_CONTEXT = 160


def id_parts() -> list[Column]:
    """What an issue's digest is made of, in its order: type, supplier, product, key, raw value, file, the context's beginning."""
    fields = [X.squeeze(F.col(c)) for c in ("issue_type", "supplier", "product", "property_key", "raw_value", "source_file")]
    return [*fields, F.substring(X.squeeze(F.col("source_context")), 1, ID_CONTEXT)]


def detect(obs: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Issues of observations joined with their records: each id once, suppressed by stronger ones of the same observation.

    Of issues with one id the first by `order` stays, and by all columns where that leaves ties.
    """
    found = evaluate(context_features(obs), rules())
    found = found.withColumn("issue_id", issue_id(F.col("confidence"), id_parts()))
    once = first_wins(found, ["issue_id"], [*order, *[F.col(c) for c in obs.columns]])
    plain = {c: X.squeeze(F.col(c)) for c in ("source_file", "product", "property_key", "raw_value", "source_context")}
    key = [*list(plain.values())[:4], F.substring(plain["source_context"], 1, CONTEXT_KEY)]
    keyed = once.withColumn("__key", F.struct(*[F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(key)]))
    kept = suppress_by_high(suppress_pairs(keyed, ["__key"], SUPPRESSED), ["__key"])
    return kept.select("issue_id", "confidence", "issue_type", *obs.columns)
