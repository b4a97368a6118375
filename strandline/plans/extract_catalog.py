"""Queries on extraction's guards, routing, recovery and rejections, over datasheet rows made from part's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import BY_KEY
from ..scratch import spread
from .catalog import query, table

#: Rows of one datasheet a part; {n} is its size (1 to 50) and {d} its size in hundredths over 1.
ROWS = [
    "Density | not applicable | {d} g/cm3",
    "Charpy impact strength | no break | {n} kJ/m2",
    "Diameter tolerance | 0.05 mm",
    "Hardness (Shore A) | {n}",
    "Flame retardancy (UL94) | V-0",
    "Tensile strength according to ISO 527 at 50 mm/min for a width of {n} MPa",
    "Izod Impact Strength | ISO 180/A | kJ/m2 | {n}",
    "Notched Izod impact strength | {n} kJ/m2 | ASTM D256",
    "Melt flow index | {n} g/10min | 2.16 kg",
    "Water absorption [%](2) | 0.{n} | 24 h",
    "Glass transition temperature | {n}{n} MPa | {n} °C",
    "Elongation at break | {n} %",
    "{d} ft-lb/in | ASTM D256",
    "Heat deflection temperature (0.45 MPa) | {n} °C",
]


def sheets(spark, sf):
    size = F.col("p_size").cast("string")
    value = F.format_string("%.2f", 1 + F.col("p_size") / 100)
    rows = [F.replace(F.replace(F.lit(r), F.lit("{n}"), size), F.lit("{d}"), value) for r in ROWS]
    parts = spread(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("material_id"), "p_size"), "material_id")
    return parts.select("material_id", F.lit("").alias("text"), F.array(*rows).alias("rows"))


def _fits(key: str, value: str) -> str:
    """Whether a value is in the property dictionary's plausible range."""
    return f"{value} BETWEEN {BY_KEY[key][7]} AND {BY_KEY[key][8]}"


#: (key, raw, number, unit, method, condition, flags, when it is read) of what the rows give; a bare 2 beside m2 is an exponent.
READ = [
    ("impact_charpy", "n", "p_size", "kJ/m2", None, "break", None, "p_size <> 2"),
    ("diameter_tolerance", "'0.05'", "0.05", "mm", None, None, None, "true"),
    ("flame_retardancy", "'V-0'", "NULL", "rating", "UL94", None, "categorical", "true"),
    ("hardness_shore_a", "n", "p_size", "Shore A", None, None, None, "true"),
    ("impact_izod_area", "n", "p_size", "kJ/m2", "ISO 180/A", None, "impact_area_normalized", "p_size <> 2"),
    ("melt_flow_index", "n", "p_size", "g/10min", None, None, None, "true"),
    ("water_absorption", "'0.' || n", "('0.' || n)::DOUBLE", "%", None, "CASE WHEN p_size = 45 THEN '0.45 MPa load' END", None, "true"),  # a load by its digits
    ("glass_transition", "n", "p_size", "degC", None, None, None, "true"),
    ("elongation", "n", "p_size", "%", None, "break", None, "true"),
    ("impact_izod", "d", "d::DOUBLE * 1.3558179483314004 / 0.0254", "ft-lb/in", "ASTM D256", None, "unit_converted:ft-lb/in->J/m;impact_method_inferred:astm_izod", "true"),
    ("hdt", "n", "p_size", "degC", None, "0.45 MPa load", None, "true"),
]
_TEXT = lambda v: "NULL" if v is None else v if v.startswith("CASE") else f"'{v}'"
_PARTS = "p AS (SELECT *, p_size::VARCHAR AS n, printf('%.2f', 1 + p_size / 100.0::DOUBLE) AS d FROM part)"
RULES_SQL = f"WITH {_PARTS} " + " UNION ALL ".join(
    f"SELECT p_partkey::VARCHAR AS material_id, '{k}' AS property_key, {raw} AS raw_value, '{unit}' AS unit_raw, round(({value})::DOUBLE, 6) AS value_nominal, "
    f"{_TEXT(method)} AS test_method, {_TEXT(cond)} AS condition, {_TEXT(flags)} AS quality_flag FROM p WHERE {when}" + (f" AND {_fits(k, '(' + value + ')')}" if BY_KEY[k][7] is not None and value != "NULL" else "")
    for k, raw, value, unit, method, cond, flags, when in READ
)
REJECTED_SQL = (
    f"WITH {_PARTS} SELECT DISTINCT material_id, property_key, raw_value, reason FROM (SELECT material_id, x.k AS property_key, x.r AS raw_value, 'unit_exponent_or_footnote' AS reason FROM (SELECT p_partkey::VARCHAR AS material_id, unnest([{{'k': 'density', 'r': '3'}}, {{'k': 'impact_charpy', 'r': '2'}}, "
    "{'k': 'impact_izod', 'r': '2'}, {'k': 'impact_strength', 'r': '2'}, {'k': 'water_absorption', 'r': '2'}]) AS x FROM p)"
    " UNION ALL SELECT p_partkey::VARCHAR, 'impact_izod_area', CASE WHEN p_size = 2 THEN '256' ELSE n END, 'impact_method_unit_mismatch' FROM p"  # without the 2, the standard's number is all that is left
    + "".join(f" UNION ALL SELECT p_partkey::VARCHAR, '{k}', {raw}, 'outside_plausible_range' FROM p WHERE {when} AND NOT {_fits(k, '(' + value + ')')}" for k, raw, value, *_, when in READ if BY_KEY[k][7] is not None and value != "NULL")
    + ")"
)


@query(RULES_SQL)
def extraction_rules(spark, sf):
    """Guards, ratings, routing and recovery: what is read from rows that try to mislead."""
    from ..operators.extract import extract

    made = extract(sheets(spark, sf))[0]
    return made.select("material_id", "property_key", F.trim("raw_value").alias("raw_value"), "unit_raw", F.round("value_nominal", 6).alias("value_nominal"), "test_method", "condition", "quality_flag")


@query(REJECTED_SQL)
def extraction_rejections(spark, sf):
    """Exponents, footnotes, methods that don't fit their unit, implausible values."""
    from ..operators.extract import extract

    made = extract(sheets(spark, sf))[1]
    return made.select("material_id", "property_key", F.trim("raw_value").alias("raw_value"), "reason").distinct()
