"""Strict checks of published observations; each returns issue rows (kind, message and the observation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..scratch import written
from .query import matches

#: Ranges that published values must keep; dense fillings may weigh more.
STRICT = {
    "density": (0.45, 2.6), "nozzle_temperature": (120.0, 480.0), "bed_temperature": (0.0, 170.0), "chamber_temperature": (0.0, 180.0),
    "drying_temperature": (20.0, 160.0), "impact_charpy": (0.0, 350.0), "impact_izod_area": (0.0, 350.0), "impact_strength": (0.0, 350.0),
    "tensile_modulus": (1.0, 30000.0), "flexural_modulus": (1.0, 30000.0),
}
DENSE_LIMIT = 8.5
#: Fillings that make a material dense.
DENSE = r"(?i)bronze|copper|iron|magnetic|magnetite|metal|steel|tungsten"


#: Columns of an observation that an issue shows.
SHOWN = ("supplier", "product", "source_file", "property_key", "raw_value", "value_nominal", "source_context")


def hit(when: Column, kind: str, message: str | Column) -> Column:
    """(kind, message) where the check fails, else null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("message")))


def missing_sources(materials: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose local source isn't among the files (source_file)."""
    local = materials.where((F.coalesce("source_file", F.lit("")) != "") & ~F.col("source_file").rlike(r"(?i)^https?://"))
    return local.join(files.select("source_file"), "source_file", "left_anti").select(
        F.lit("missing_source_path").alias("kind"), F.concat(F.lit("Source path does not exist: "), "source_file").alias("message"), "supplier", "product", "source_file"
    )


def exponent_captures() -> list[Column]:
    """Values that are a unit's exponent."""
    raw = F.trim(F.translate(F.coalesce("raw_value", F.lit("")), ",", "."))
    form = X.normalize_unit_text(F.col("source_context"))
    key, value = F.col("property_key"), F.col("value_nominal")
    has = lambda s: F.contains(form, F.lit(s))
    cases = [
        (key == "density") & (F.abs(value - 3) < 1e-9) & has("g/cm3"),
        key.isin("melt_volume_rate", "max_volumetric_speed") & raw.rlike(r"^3(?:\.0+)?$") & (has("cm3") | has("mm3")),
        key.isin("impact_charpy", "impact_strength") & raw.rlike(r"^2(?:\.0+)?$") & has("j/m2"),
    ]
    return [hit(value.isNotNull() & c, "unit_exponent_capture", "The value appears to be a unit's exponent.") for c in cases]


def outside_ranges() -> list[Column]:
    span = F.create_map(*[x for k, v in STRICT.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    r = F.try_element_at(span, F.col("property_key"))
    dense = F.concat_ws(" ", "supplier", "product", "base_material", "material_family", "source_file").rlike(DENSE)
    high = F.when((F.col("property_key") == "density") & dense, F.lit(DENSE_LIMIT)).otherwise(r[1])
    bad = r.isNotNull() & F.col("value_nominal").isNotNull() & ~F.col("value_nominal").between(r[0], high)
    return [hit(bad, "outside_strict_range", F.concat("property_key", F.lit("="), X.significant(F.col("value_nominal")), F.lit(" is outside its strict range.")))]


def impact_methods() -> list[Column]:
    """Impact values whose flags, unit or method don't fit their key; one observation can give several."""
    key = F.col("property_key")
    flags, family = X.flag_list(F.col("quality_flag")), C.impact_unit(F.col("unit_canonical"))
    method = C.impact_method(F.concat_ws(" ", "test_method", "source_context"))
    label = F.lower(F.concat_ws(" ", "property_key", "property_label", "raw_label"))
    told = F.exists(flags, lambda f: f.startswith("impact_method_unit_mismatch:"))
    area = key.isin("impact_charpy", "impact_izod_area", "impact_strength")
    wrong = ~F.coalesce(family == F.when(key == "impact_izod", "linear").otherwise("area"), F.lit(False))
    impact = key.isin("impact_charpy", "impact_izod", "impact_izod_area", "impact_strength")
    return [
        hit(impact & F.array_contains(flags, "unit_not_converted"), "impact_unit_not_converted", "Impact value has an unconverted unit."),
        hit((area | (key == "impact_izod")) & wrong, "impact_key_unit_family_mismatch", "The canonical unit is of the other impact family."),
        hit(impact & (method == "astm_izod_linear") & (key != "impact_izod") & ~told, "impact_method_key_mismatch", "ASTM D256/D4812 belongs under linear Izod."),
        hit(impact & (method == "iso_izod_area") & (key != "impact_izod_area") & ~((key == "impact_charpy") & F.contains(label, F.lit("charpy"))), "impact_method_key_mismatch", "ISO 180 belongs under area-normalized Izod."),
        hit(impact & (method == "charpy_area") & ~key.isin("impact_charpy", "impact_strength"), "impact_method_key_mismatch", "ISO 179/ASTM D6110 belongs under Charpy or generic impact."),
    ]


#: Fixed values: (supplier, product part, file part, key, value wanted, tolerance, value barred); no value wanted if null.
GOLDEN = [
    ("Prusa Polymers", "", "1_PLA_Prusament_TDS_2022_EN.pdf", "density", 1.24, 0.005, 3.0),
    ("Prusa Polymers", "", "TDS_Prusament_PLA-Blend_EN.pdf", "density", 1.24, 0.005, 3.0),
    ("MatterHackers", "Build Series PLA", "", "density", 1.25, 0.02, 3.0),
]
#: Fixed values: (supplier, product part, key, least, most).
GOLDEN_RANGES = [("3DXTech", "3DXMAX ABS", "nozzle_temperature", 120.0, None), ("3DXTech", "3DXMAX ABS", "bed_temperature", None, 170.0)]


def golden_marks() -> Column:
    """For each golden record that an observation belongs to: its number, and whether the observation is the wanted, the barred or any value."""
    key, value = F.col("property_key"), F.col("value_nominal")
    no = F.lit(False)
    one = lambda i, own, here, bad, seen: F.when(own, F.struct(F.lit(i).alias("golden"), *[F.coalesce(c, no).alias(n) for c, n in ((here, "here"), (bad, "bad"), (seen, "seen"))]))
    marks = []
    for supplier, product, file, k, want, near, barred in GOLDEN:
        of = key == k
        marks.append(one(len(marks), matches(supplier, product, file), of & (F.abs(value - want) <= near), of & (F.abs(value - barred) <= 0.005), of & value.isNotNull()))
    for supplier, product, k, least, most in GOLDEN_RANGES:
        off = (value < least) if least is not None else (value > most)
        marks.append(one(len(marks), matches(supplier, product) & (key == k) & off, no, no, no))
    return F.array_compact(F.array(*marks))


def golden_records(marks: DataFrame) -> DataFrame:
    """Known products publish known values: (kind, message), from the counts of marks by golden record."""
    spark, n = marks.sparkSession, len(GOLDEN)
    names = [f"{s} {p or f} {k}" for s, p, f, k, *_ in GOLDEN] + [f"{s} {p} {k}" for s, p, k, *_ in GOLDEN_RANGES]
    known = spark.createDataFrame([(i, t, i < n and bool(GOLDEN[i][2])) for i, t in enumerate(names)], "golden int, message string, must boolean")
    made = marks.groupBy("golden").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in ("here", "bad", "seen")])
    rows = lambda c: F.coalesce(c, F.lit(0))
    fixed = F.col("golden") < n
    kinds = F.array_compact(
        F.array(
            F.when(fixed & F.col("must") & (rows("rows") == 0), "missing_golden_record"),
            F.when(fixed & (rows("rows") > 0) & (rows("here") == 0) & (F.col("must") | (rows("seen") > 0)), "golden_density_mismatch"),
            F.when(fixed & (rows("bad") > 0), "golden_density_exponent"),
            F.when(~fixed & (rows("rows") > 0), "golden_nozzle_bed_mixup"),
        )
    )
    return known.join(made, "golden", "left").select(F.explode(kinds).alias("kind"), "message")


def observed(obs: DataFrame) -> DataFrame:
    """Issues and golden marks of all observations, from one pass: `golden` is null for an issue."""
    issues = F.array_compact(F.array(*exponent_captures(), *outside_ranges(), *impact_methods()))
    mark = "struct<kind: string, message: string, golden: int, here: boolean, bad: boolean, seen: boolean>"
    null = lambda *names: [F.lit(None).alias(n) for n in names]
    told = F.transform(issues, lambda x: F.struct(x["kind"], x["message"], *null("golden", "here", "bad", "seen")).cast(mark))
    marks = F.transform(golden_marks(), lambda x: F.struct(*null("kind", "message"), x["golden"], x["here"], x["bad"], x["seen"]).cast(mark))
    return obs.select(*SHOWN, F.explode(F.concat(told, marks)).alias("x")).select("x.*", *SHOWN)


def audit(materials: DataFrame, obs: DataFrame, files: DataFrame) -> DataFrame:
    """All checks; obs carries the record's columns. What one pass over the observations finds is written, as it is read twice."""
    found = written(observed(obs))
    issues = found.where("golden IS NULL").select("kind", "message", *SHOWN)
    parts = [missing_sources(materials, files), issues, golden_records(found.where("golden IS NOT NULL").select("golden", "here", "bad", "seen"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
