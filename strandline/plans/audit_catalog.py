"""Queries that plant every fault the issue rules and strict checks look for, with SQL that works the rules out anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.issues import HINTS
from ..scratch import spread
from .catalog import query, table

#: property_key, raw_value, value, what large parts add to it, unit_raw, test_method, orientation, condition, source_context.
CASES = [
    ("tensile_strength", "527", 527.0, 0.0, "MPa", "ISO 527", "", "", "Tensile strength | ISO 527 | 527"),
    ("surface_resistance", "1013", 1013.0, 0.0, "ohm", "", "", "", "Surface resistance | >1013 ohm"),
    ("surface_resistance", "257", 257.0, 0.0, "ohm", "", "", "", "Surface resistance | D257 | 257 ohm"),
    ("surface_resistance", "257", 257.0, 0.0, "ohm", "ASTM D257", "", "", "Surface resistance | ASTM D257 | 257"),
    ("insulation_resistance", "1.8", 1.8, 5.0, "ohm", "", "", "", "Insulation resistance | 1.8 MPa"),
    ("surface_resistance", "160-300", 230.0, 0.0, "ohm", "", "", "", "Printing filament | 160-300"),
    ("density", "60", 60.0, 0.0, "g/cm3", "", "", "", "Infill density | 60 %"),
    ("density", "1.24", 1.24, 0.0, "g/cm3", "ISO 1183", "", "", "Density | 1.24 g/cm3 | ISO 1183"),
    ("impact_charpy", "3.0", 3.0, 0.0, "kJ/m2", "", "", "", "Version: 3.0 | Charpy impact strength"),
    ("impact_izod", "4", 4.0, 0.0, "J/m", "", "", "", "Izod impact strength | No break | 4"),
    ("impact_charpy", "2", 2.0, 0.0, "kJ/m2", "", "", "", "Charpy impact strength [kJ/m2](2) | 50"),
    ("tensile_strength", "12", 12.0, 0.0, "MPa", "", "", "", "Elongation at break | 12 %"),
    ("tensile_modulus", "2", 2.0, 2000.0, "MPa", "", "", "", "Tensile modulus | 2 mm/min"),
    ("print_speed", "1.75", 1.75, 50.0, "mm/s", "", "", "", "Print speed | diameter 1.75"),
    ("nozzle_temperature", "60", 60.0, 150.0, "degC", "", "", "", "Print speed | 60"),
    ("chamber_temperature", "7", 7.0, 60.0, "degC", "", "", "", "Chamber temperature | note 7"),
    ("annealing_temperature", "220", 220.0, -100.0, "degC", "", "", "", "Nozzle temperature | 220"),
    ("melt_flow_index", "190", 190.0, -100.0, "g/10min", "", "", "", "Melt flow index | 190 °C / 2.16 kg"),
    ("filament_length", "1.75", 1.75, 400.0, "m", "", "", "", "1.75mm | 330 - 340 m"),
    ("tensile_modulus", "1.234", 1.234, 1200.0, "MPa", "", "", "", "Tensile modulus | 1.234 | 1,234 MPa"),
    ("vicat", "306", 306.0, 0.0, "degC", "ISO 306", "", "", "Vicat softening | ISO 306 | 306"),
    ("impact_izod", "5", 5.0, 0.0, "kJ/m2", "", "", "", "Izod impact strength | 5 kJ/m2"),
    ("tensile_strength", "50", 50.0, 0.0, "MPa", "", "", "0.45 MPa load", "Tensile strength | 50 MPa | 0.45 MPa load"),
    ("tensile_strength", "51", 51.0, 0.0, "MPa", "", "XY", "", "Tensile strength (Z) | 51 MPa"),
    ("elongation", "150", 150.0, -100.0, "%", "", "", "", "Elongation at break | 150 %"),
    ("flexural_modulus", "50", 50.0, 1900.0, "MPa", "", "", "", "Flexural modulus | 50 MPa"),
]
COLUMNS = ["property_key", "raw_value", "value", "more", "unit_raw", "test_method", "orientation", "condition", "source_context"]
LARGE = 25


def planted(spark, sf):
    """Each case for each part; large parts have other values."""
    cases = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(COLUMNS, c)]) for c in CASES])
    rows = spread(table(spark, sf, "part"), "p_partkey").select("*", F.posexplode(cases).alias("case_no", "c"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.col("p_partkey").alias("material_id"), F.col("p_brand").alias("supplier"), F.col("p_name").alias("product"), F.col("p_type").alias("base_material"),
        F.col("p_type").alias("material_family"), F.concat(F.lit("f"), text("p_partkey")).alias("source_file"), "c.property_key", F.col("c.property_key").alias("property_label"),
        F.lit("").alias("raw_label"), "c.raw_value", F.when(F.col("p_size") > LARGE, F.col("c.value") + F.col("c.more")).otherwise(F.col("c.value")).alias("value_nominal"),
        "c.unit_raw", F.col("c.unit_raw").alias("unit_canonical"), "c.test_method", "c.orientation", "c.condition", "c.source_context", F.lit("").alias("quality_flag"),
    )


def _quoted(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE"


def _hint(cell: str) -> str:
    """The first hint of a cell; RE2 has no look-behind, so infill density is ruled out beside the pattern."""
    out = []
    for key, pattern in HINTS:
        plain = pattern.replace(r"(?<!infill\s)", "")
        also = f" AND NOT regexp_matches({cell}, '(?i)infill\\s+density')" if plain != pattern else ""
        out.append(f"WHEN regexp_matches({cell}, {_quoted('(?i)' + plain)}){also} THEN '{key}'")
    return "CASE " + " ".join(out) + " END"


PLANTED_SQL = (
    f"c({', '.join(COLUMNS)}) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_quoted, c)) + ")" for c in CASES)
    + f"""), planted AS (SELECT p_partkey AS material_id, p_brand AS supplier, p_name AS product, p_type AS family, 'f' || p_partkey AS source_file, property_key AS k, raw_value AS raw,
 CASE WHEN p_size > {LARGE} THEN value + more ELSE value END AS v, unit_raw AS unit, test_method AS method, orientation AS orient, condition AS cond, source_context AS ctx,
 lower(source_context) AS low, string_split(source_context, ' | ') AS cells FROM part, c)"""
)
ISSUES_SQL = f"""WITH {PLANTED_SQL},
placed AS (SELECT *, list_position(list_transform(cells, lambda x: contains(replace(x, ' ', ''), replace(raw, ' ', ''))), true) AS i FROM planted),
hinted AS (SELECT *, list_filter(list_transform(range(1, coalesce(i, 0) + 1), lambda j: {{'j': j, 'h': {_hint("cells[j]")}}}), lambda x: x.h IS NOT NULL) AS hs,
 lower(array_to_string(cells[greatest(coalesce(i, 1) - 3, 1):coalesce(i, 1) + 1], ' | ')) AS near FROM placed),
f AS (SELECT *, hs[len(hs)].h AS hint, coalesce(cells[hs[len(hs)].j], '') AS label,
 k IN ('surface_resistance', 'insulation_resistance') AS ohm, regexp_matches(raw, '10[0-9]{{2}}') OR regexp_matches(ctx, '(?i)[x×]\\s*10[0-9]+') AS power,
 k IN ('impact_charpy', 'impact_izod', 'impact_strength') AS impact, k IN ('tensile_strength', 'tensile_modulus', 'flexural_strength', 'flexural_modulus') AS strong,
 regexp_matches(concat_ws(' ', supplier, product, family), '(?i)\\b(TPU|TPE|PEBA|flex|varioshore|shore\\s*a)\\b') AS flexible,
 CASE raw WHEN '527' THEN 'iso527' WHEN '178' THEN 'iso178' WHEN '179' THEN 'iso179' WHEN '306' THEN 'iso306' WHEN '306.10' THEN 'iso306/10n' WHEN '1183' THEN 'iso1183' WHEN '257' THEN 'astmd257' WHEN '638' THEN 'astmd638' WHEN '790' THEN 'astmd790' END AS code FROM hinted),
g AS (SELECT *, v <= 2 AND (contains(low, 'mpa') OR contains(low, 'resistivity')) AS small,
 CASE WHEN regexp_matches(upper(label), '\\bZ\\b') THEN 'Z' WHEN regexp_matches(upper(label), '\\(Y[- ]?Z\\)|\\bYZ\\b') THEN 'YZ' WHEN regexp_matches(upper(label), '\\bX[- ]?Y\\b') THEN 'X-Y' END AS told FROM f),
hits AS (SELECT *, unnest(list_filter([
 CASE WHEN code IS NOT NULL AND (contains(replace(low, ' ', ''), code) OR contains(replace(lower(method), ' ', ''), code)) THEN 'high:test_method_code_captured_as_property_value' END,
 CASE WHEN ohm AND power THEN 'high:electrical_power_notation_flattened' END,
 CASE WHEN ohm AND NOT power AND raw IN ('257', '1183') THEN 'high:electrical_test_or_density_standard_captured' END,
 CASE WHEN ohm AND NOT power AND raw NOT IN ('257', '1183') AND small THEN 'high:electrical_value_captured_from_neighboring_field' END,
 CASE WHEN ohm AND NOT power AND raw NOT IN ('257', '1183') AND NOT small AND (contains(low, 'printing filament') OR contains(raw, '160-300')) THEN 'high:electrical_property_captured_from_commercial_text' END,
 CASE WHEN k = 'density' AND contains(low, 'infill density') THEN 'high:infill_density_captured_as_material_density' END,
 CASE WHEN impact AND contains(low, 'version: 3.0') AND regexp_full_match(raw, '3(\\.0+)?') THEN 'high:document_version_captured_as_impact_value' END,
 CASE WHEN impact AND (contains(low, 'not applicable') OR contains(low, 'no break')) AND regexp_full_match(raw, '[1-5](\\.0+)?') THEN 'high:not_applicable_impact_row_published_as_number' END,
 CASE WHEN impact AND regexp_matches(ctx, '(?i)\\[[^\\]]*kJ/m\\s*2[^\\]]*\\]\\s*\\([0-9]+\\)') AND regexp_full_match(raw, '[1-5](\\.0+)?') THEN 'high:impact_footnote_marker_captured_as_value' END,
 CASE WHEN (strong OR k = 'elongation') AND hint IS NOT NULL AND hint <> k AND ((contains(near, '%') AND k <> 'elongation') OR contains(near, 'kj/m') OR contains(near, 'g/cm') OR (contains(near, 'mpa') AND k = 'elongation'))
  THEN 'high:neighboring_property_value_captured' END,
 CASE WHEN strong AND v <= 5 AND regexp_matches(near, 'mm ?/ ?min') THEN 'high:test_speed_captured_as_mechanical_property' END,
 CASE WHEN k = 'print_speed' AND v < 5 AND (contains(low, 'extrusion multiplier') OR contains(low, 'diameter') OR contains(raw, '1.75')) THEN 'high:print_speed_captured_from_multiplier_or_diameter' END,
 CASE WHEN k = 'nozzle_temperature' AND v < 150 AND (contains(low, 'print speed') OR contains(raw, '40-250')) THEN 'high:nozzle_temperature_captured_from_print_speed' END,
 CASE WHEN k = 'chamber_temperature' AND v < 20 THEN 'high:chamber_temperature_captured_from_note_number' END,
 CASE WHEN k = 'annealing_temperature' AND v > 200 AND hint <> k THEN 'high:annealing_temperature_captured_from_neighboring_print_setting' END,
 CASE WHEN k = 'melt_flow_index' AND v > 150 AND (contains(low, '°c') OR contains(low, 'kg')) THEN 'high:mfi_test_temperature_captured_as_flow_value' END,
 CASE WHEN k = 'filament_length' AND v < 10 AND contains(low, '1.75mm') AND regexp_matches(low, '\\b3[0-9]{{2}}\\s*-\\s*3[0-9]{{2}}\\s*m') THEN 'high:filament_diameter_captured_as_length' END,
 CASE WHEN k IN ('tensile_modulus', 'flexural_modulus') AND v < 100 AND regexp_full_match(raw, '[0-9]{{1,2}}\\.[0-9]{{3}}') AND contains(ctx, replace(raw, '.', ',')) THEN 'high:thousands_separator_parsed_as_decimal' END,
 CASE WHEN k = 'vicat' AND raw IN ('306', '306.10') THEN 'high:vicat_method_and_load_captured_as_temperature' END,
 CASE WHEN k IN ('impact_izod', 'impact_strength') AND lower(unit) = 'kj/m2' THEN 'medium:impact_method_unit_semantics_ambiguous' END,
 CASE WHEN k <> 'hdt' AND regexp_matches(low, '(0.45|1.8) mpa load') AND regexp_matches(lower(cond), '(0.45|1.8) mpa load') THEN 'medium:hdt_load_condition_bleeds_into_other_property' END,
 CASE WHEN told IS NOT NULL AND orient <> '' AND told <> orient THEN 'medium:orientation_metadata_mismatch' END,
 CASE WHEN k = 'elongation' AND v > 100 AND NOT flexible AND code IS NULL THEN 'uncertain:high_elongation_outlier_for_rigid_material' END,
 CASE WHEN k IN ('tensile_modulus', 'flexural_modulus') AND v > 0 AND v < 100 AND NOT flexible THEN 'uncertain:very_low_modulus_outlier_for_rigid_material' END
], lambda x: x IS NOT NULL)) AS hit FROM g),
named AS (SELECT *, split_part(hit, ':', 1) AS confidence, split_part(hit, ':', 2) AS issue_type FROM hits),
seen AS (SELECT *, list(issue_type) OVER w AS types, max(confidence = 'high') OVER w AS sure FROM named WINDOW w AS (PARTITION BY source_file, product, k, raw, ctx[1:240]))
SELECT material_id, issue_type, confidence, upper(confidence[1]) || '-' || sha1(concat_ws(chr(10), issue_type, supplier, product, k, raw, source_file, ctx[1:160]))[1:12] AS issue_id FROM seen
WHERE NOT (issue_type = 'electrical_test_or_density_standard_captured' AND list_contains(types, 'test_method_code_captured_as_property_value'))
 AND NOT (issue_type = 'test_method_code_captured_as_property_value' AND list_contains(types, 'vicat_method_and_load_captured_as_temperature')) AND (confidence = 'high' OR NOT sure)"""


@query(ISSUES_SQL)
def issue_rules(spark, sf):
    """All 24 rules over planted faults, with suppression and the issues' ids."""
    from ..operators.issues import detect

    return detect(planted(spark, sf)).select("material_id", "issue_type", "confidence", "issue_id")


#: property_key, raw_value, value, what large parts add to it, unit_canonical, test_method, quality_flag, source_context.
CHECKED = [
    ("density", "3", 3.0, 0.0, "g/cm3", "", "", "Density [g/cm³] | 3"),
    ("density", "1.24", 1.24, 2.0, "g/cm3", "", "", "Density | 1.24 g/cm3"),
    ("melt_volume_rate", "3.0", 3.0, 0.0, "cm3/10min", "", "", "MVR [cm3/10 min] | 3.0"),
    ("impact_charpy", "2", 2.0, 0.0, "kJ/m2", "ISO 179", "", "Charpy [kJ/m²] | 2"),
    ("nozzle_temperature", "220", 220.0, 400.0, "degC", "", "", "Nozzle temperature | 220"),
    ("drying_temperature", "70", 70.0, -60.0, "degC", "", "", "Drying | 70"),
    ("impact_strength", "12", 12.0, 0.0, "", "", "unit_not_converted", "Impact strength | 12"),
    ("impact_izod", "40", 40.0, 0.0, "kJ/m2", "ASTM D256", "", "Izod | ASTM D256 | 40"),
    ("impact_charpy", "41", 41.0, 0.0, "kJ/m2", "ASTM D256", "", "Charpy | ASTM D256 | 41"),
    ("impact_charpy", "42", 42.0, 0.0, "kJ/m2", "ASTM D256", "impact_method_unit_mismatch:told", "Charpy | ASTM D256 | 42"),
    ("impact_izod", "43", 43.0, 0.0, "J/m", "ISO 180", "", "Izod | ISO 180 | 43"),
    ("impact_izod_area", "44", 44.0, 0.0, "kJ/m2", "ISO 179", "", "Izod | ISO 179 | 44"),
    ("impact_izod_area", "45", 45.0, 400.0, "kJ/m2", "ISO 180", "", "Izod | ISO 180 | 45"),
    ("tensile_modulus", "2", 2.0, -1.5, "MPa", "", "", "Tensile modulus | 2"),
]
CHECKED_COLUMNS = ["property_key", "raw_value", "value", "more", "unit_canonical", "test_method", "quality_flag", "source_context"]


def checked(spark, sf):
    """Each case for each part; large parts have other values, and every third part's file is missing."""
    cases = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(CHECKED_COLUMNS, c)]) for c in CHECKED])
    rows = spread(table(spark, sf, "part"), "p_partkey").select("*", F.explode(cases).alias("c"))
    return rows.select(
        F.col("p_brand").alias("supplier"), F.col("p_name").alias("product"), F.col("p_type").alias("base_material"), F.col("p_type").alias("material_family"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("source_file"), "c.property_key", F.col("c.property_key").alias("property_label"), F.lit("").alias("raw_label"),
        "c.raw_value", F.when(F.col("p_size") > LARGE, F.col("c.value") + F.col("c.more")).otherwise(F.col("c.value")).alias("value_nominal"),
        "c.unit_canonical", "c.test_method", "c.quality_flag", "c.source_context",
    )


CHECKS_SQL = f"""WITH c({', '.join(CHECKED_COLUMNS)}) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, c)) + ')' for c in CHECKED)}),
o AS (SELECT p_partkey, p_size, 'f' || p_partkey AS source_file, p_brand || ' ' || p_name || ' ' || p_type AS named, c.*, CASE WHEN p_size > {LARGE} THEN value + more ELSE value END AS v,
 replace(replace(replace(replace(lower(source_context), ' ', ''), '|', ''), '²', '2'), '³', '3') AS form, upper(test_method || ' ' || source_context) AS told,
 CASE WHEN unit_canonical IN ('kJ/m2', 'J/m2') THEN 'area' WHEN unit_canonical IN ('J/m', 'ft-lb/in') THEN 'linear' END AS family FROM part, c),
lim(k, lo, hi) AS (VALUES ('density', 0.45, 2.6), ('nozzle_temperature', 120, 480), ('bed_temperature', 0, 170), ('chamber_temperature', 0, 180), ('drying_temperature', 20, 160),
 ('impact_charpy', 0, 350), ('impact_izod_area', 0, 350), ('impact_strength', 0, 350), ('tensile_modulus', 1, 30000), ('flexural_modulus', 1, 30000)),
m AS (SELECT *, CASE WHEN regexp_matches(told, 'ISO ?180') THEN 'iso180' WHEN regexp_matches(told, 'ISO ?179|D ?6110') THEN 'charpy' WHEN regexp_matches(told, 'D ?(256|4812)') THEN 'izod' END AS method,
 property_key LIKE 'impact%' AS impact, contains(quality_flag, 'impact_method_unit_mismatch:') AS flagged FROM o),
found AS (
 SELECT 'missing_source_path' AS kind, 'f' || p_partkey AS source_file, NULL AS property_key, NULL AS raw_value FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 'unit_exponent_capture', source_file, property_key, raw_value FROM o WHERE (property_key = 'density' AND v = 3 AND contains(form, 'g/cm3'))
  OR (property_key IN ('melt_volume_rate', 'max_volumetric_speed') AND regexp_full_match(raw_value, '3(\\.0+)?') AND (contains(form, 'cm3') OR contains(form, 'mm3')))
  OR (property_key IN ('impact_charpy', 'impact_strength') AND regexp_full_match(raw_value, '2(\\.0+)?') AND contains(form, 'j/m2'))
 UNION ALL SELECT 'outside_strict_range', source_file, property_key, raw_value FROM o JOIN lim ON k = property_key
  WHERE v < lo OR v > CASE WHEN property_key = 'density' AND regexp_matches(named, '(?i)bronze|copper|iron|magnetic|magnetite|metal|steel|tungsten') THEN 8.5 ELSE hi END
 UNION ALL SELECT 'impact_unit_not_converted', source_file, property_key, raw_value FROM m WHERE impact AND quality_flag = 'unit_not_converted'
 UNION ALL SELECT 'impact_key_unit_family_mismatch', source_file, property_key, raw_value FROM m WHERE impact AND family IS DISTINCT FROM CASE WHEN property_key = 'impact_izod' THEN 'linear' ELSE 'area' END
 UNION ALL SELECT 'impact_method_key_mismatch', source_file, property_key, raw_value FROM m WHERE impact AND method = 'izod' AND property_key <> 'impact_izod' AND NOT flagged
 UNION ALL SELECT 'impact_method_key_mismatch', source_file, property_key, raw_value FROM m WHERE impact AND method = 'iso180' AND property_key NOT IN ('impact_izod_area', 'impact_charpy')
 UNION ALL SELECT 'impact_method_key_mismatch', source_file, property_key, raw_value FROM m WHERE impact AND method = 'charpy' AND property_key NOT IN ('impact_charpy', 'impact_strength')
 UNION ALL SELECT 'missing_golden_record', NULL, NULL, NULL FROM range(2))
SELECT kind, source_file, property_key, raw_value, count(*) AS n FROM found GROUP BY ALL"""


@query(CHECKS_SQL)
def strict_checks(spark, sf):
    """All five strict checks over planted observations: files, exponents, ranges, impact methods and golden products (which these tables lack)."""
    from ..operators.audit import audit

    obs = checked(spark, sf)
    parts = table(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("source_file"), F.col("p_brand").alias("supplier"), F.col("p_name").alias("product"), "p_partkey")
    found = spread(audit(parts.drop("p_partkey"), obs, parts.where("p_partkey % 3 <> 0")), "source_file")  # then a group is counted where its file is
    return found.groupBy("kind", "source_file", "property_key", "raw_value").agg(F.count(F.lit(1)).alias("n"))
