"""Properties, their plausible ranges, and the record types."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Property(NamedTuple):
    """One row of the property dictionary."""

    key: str
    label: str
    category: str
    unit: str
    patterns: tuple[str, ...]
    radar: bool = False
    higher_is_better: bool = True
    low: float | None = None
    high: float | None = None


def _p(key, label, category, unit, patterns, span=(None, None), radar=False, up=True):
    return Property(key, label, category, unit, tuple(patterns), radar, up, *span)


SPECS, PRINT, PHYS, MECH, HEAT, SAFE = "Filament specs", "Print settings", "Physical", "Mechanical", "Thermal", "Safety / chemical"
#: The property dictionary; ranges are those outside which a value isn't published.
PROPERTIES = [
    _p("diameter", "Filament diameter", SPECS, "mm", ["diameter"], (0.5, 5)),
    _p("diameter_tolerance", "Diameter tolerance", SPECS, "mm", ["diameter tolerance", "tolerance"], (0, 0.5)),
    _p("roundness_deviation", "Roundness deviation", SPECS, "mm", ["roundness"], (0, 0.5)),
    _p("net_weight", "Net filament weight", SPECS, "kg", ["net filament weight", "net weight"], (0.05, 20)),
    _p("filament_length", "Filament length", SPECS, "m", ["filament length"], (1, 5000)),
    _p("nozzle_temperature", "Nozzle / extruder temperature", PRINT, "degC", ["nozzle temperature", "extruder temperature", "extrusion temp", "print temperature", "suggested print temperature"], (100, 550)),
    _p("bed_temperature", "Bed / build plate temperature", PRINT, "degC", ["bed temperature", r"\bbed temp\b", "build plate temperature", "build plate temp", "build platform temperature", "heatbed temperature", "suggested bed temperature"], (0, 170)),
    _p("chamber_temperature", "Chamber temperature", PRINT, "degC", ["chamber temperature", "chamber temp"], (0, 180)),
    _p("drying_temperature", "Drying temperature", PRINT, "degC", ["drying", "drying temp", "drying temperature"], (20, 220)),
    _p("annealing_temperature", "Annealing temperature", PRINT, "degC", ["annealing", "annealing temp", "annealing temperature"], (20, 300)),
    _p("print_speed", "Print speed", PRINT, "mm/s", ["print speed", "printing speed"], (1, 1000)),
    _p("max_volumetric_speed", "Max volumetric speed", PRINT, "mm3/s", ["volumetric speed"], (0.1, 100)),
    _p("density", "Density / specific gravity", PHYS, "g/cm3", ["density", "specific gravity"], (0.5, 5), True, False),
    _p("melt_flow_index", "Melt flow index / MFR", PHYS, "g/10min", ["melt flow index", "melt index", "mfr", "melt mass-flow rate"], (0, 500)),
    _p("melt_volume_rate", "Melt volume rate / MVR", PHYS, "cm3/10min", ["mvr", "melt volume"], (0, 500)),
    _p("water_absorption", "Water / moisture absorption", PHYS, "%", ["water absorption", "moisture absorption", "saturated water absorption", "equilibrium water absorption"], (0, 100)),
    _p("shrinkage", "Shrinkage", PHYS, "%", ["shrinkage"], (0, 100)),
    _p("light_transmission", "Light transmission", PHYS, "%", ["light transmission"], (0, 100)),
    _p("tensile_strength", "Tensile strength / stress", MECH, "MPa", ["tensile .*strength", "tensile .*stress", "tensile yield strength"], (0, 300), True),
    _p("tensile_modulus", "Tensile / Young's modulus", MECH, "MPa", ["young.?s modulus", "tensile modulus"], (0, 100000), True),
    _p("elongation", "Elongation / strain", MECH, "%", ["elongation", "breaking elongation", "flexural strain"], (0, 1500), True),
    _p("flexural_strength", "Flexural / bending strength", MECH, "MPa", ["flexural strength", "bending strength"], (0, 500), True),
    _p("flexural_modulus", "Flexural / bending modulus", MECH, "MPa", ["flexural modulus", "bending modulus"], (0, 100000), True),
    _p("impact_charpy", "Charpy impact strength", MECH, "kJ/m2", ["charpy.*impact", "impact strength charpy"], (0, 500), True),
    _p("impact_izod", "Izod impact strength", MECH, "J/m", ["izod.*impact", "notched izod"], (0, 10000)),
    _p("impact_izod_area", "Izod impact strength (area-normalized)", MECH, "kJ/m2", [], (0, 500)),
    _p("impact_strength", "Impact strength", MECH, "kJ/m2", ["impact strength"], (0, 500), True),
    _p("hardness_shore_d", "Hardness Shore D", MECH, "Shore D", ["shore d", "hardness"], (20, 120)),
    _p("hardness_shore_a", "Hardness Shore A", MECH, "Shore A", ["shore a"], (20, 120)),
    _p("hdt", "Heat deflection / distortion temperature", HEAT, "degC", ["heat deflection", "heat distortion", "hdt", "thermal deformation"], (20, 450), True),
    _p("vicat", "Vicat softening temperature", HEAT, "degC", ["vicat", "vicar softening"], (20, 450), True),
    _p("glass_transition", "Glass transition temperature", HEAT, "degC", ["glass transition", r"\btg\b"], (-100, 450), True),
    _p("melting_temperature", "Melting temperature", HEAT, "degC", ["melting temperature", r"\btm\b"], (20, 500), True),
    _p("crystallization_temperature", "Crystallization temperature", HEAT, "degC", ["crystallization temperature"], (20, 450)),
    _p("decomposition_temperature", "Decomposition temperature", HEAT, "degC", ["decomposition temperature"], (0, 1000)),
    _p("continuous_service_temperature", "Continuous service temperature", HEAT, "degC", ["continuous service temperature"], (-100, 500)),
    _p("max_short_term_temperature", "Maximum short-term use temperature", HEAT, "degC", ["maximum.*short.*temperature", "maximum.*use temperature"], (-100, 500)),
    _p("surface_resistance", "Surface resistance / resistivity", "Electrical", "ohm/sq", ["surface resistance", "surface resistivity"]),
    _p("insulation_resistance", "Insulation resistance", "Electrical", "ohm", ["insulation resistance"]),
    _p("flame_retardancy", "Flame retardancy", SAFE, "rating", ["flame retardancy", "flammability"]),
    _p("chemical_resistance", "Chemical resistance", SAFE, "rating", ["chemical resistance", "effect of weak acids", "effect of strong acids", "resistance to acid", "resistance to alkali", "resistance to organic solvent", "effect of oils"]),
    _p("interlayer_adhesion", "Interlayer adhesion", MECH, "MPa", ["interlayer adhesion"], (0, 1000), True),
    _p("deflection_at_flexural_strength", "Deflection at flexural strength", MECH, "mm", ["deflection at flexural"], (0, 100)),
]
BY_KEY = {p.key: p for p in PROPERTIES}


def properties(spark: SparkSession) -> DataFrame:
    """The dictionary as a small dimension, with its order."""
    rows = [(i, p.key, p.label, p.category, p.unit, p.radar, p.higher_is_better, p.low, p.high) for i, p in enumerate(PROPERTIES)]
    fields = "ord int, property_key string, property_label string, category string, unit_canonical string, radar boolean, higher_is_better boolean, low double, high double"
    return spark.createDataFrame([(*r[:7], None if r[7] is None else float(r[7]), None if r[8] is None else float(r[8])) for r in rows], fields)


SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("material_id", "supplier", "product", "source_type", "source_file")])
REJECTION_COLUMNS = ["material_id", "property_key", "property_label", "raw_value", "reason", "source_context"]
OBSERVATION_COLUMNS = [
    "material_id", "ordinal", "property_key", "property_label", "category", "raw_label", "raw_value", "unit_raw", "unit_canonical",
    "value_min", "value_max", "value_nominal", "test_method", "orientation", "condition", "source_context", "quality_flag",
]

#: The properties that summaries, thermal views, radars and the basic scope show, and the order of categories.
HERO = ["hdt", "tensile_strength", "tensile_modulus", "elongation", "density", "nozzle_temperature"]
THERMAL = ["nozzle_temperature", "bed_temperature", "chamber_temperature", "drying_temperature", "annealing_temperature"]
RADAR = ["tensile_strength", "tensile_modulus", "elongation", "flexural_strength", "flexural_modulus", "impact_strength", "impact_charpy", "hdt", "glass_transition", "density"]
BASIC = ["density", "nozzle_temperature", "bed_temperature", "chamber_temperature", "hdt", "impact_best", "tensile_strength::xy", "tensile_strength::z", "tensile_modulus::xy", "tensile_modulus::z", "flexural_modulus::xy", "flexural_modulus::z"]
CATEGORIES = [SPECS, PRINT, MECH, HEAT, PHYS, "Electrical", SAFE, "Other"]
