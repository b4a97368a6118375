import json

import pyspark.sql.functions as F

from strandline.functions import classify as C
from strandline.functions import text as X
from strandline.operators import audit as A
from strandline.operators import issues as I
from strandline.plans.text_catalog import detection_rows
from strandline.schemas import PROPERTIES, properties
from strandline.sources import readers as R
from strandline.sources import sinks as K
from strandline.streaming.ingest import extract_stream


def test_dictionary(spark):
    df = properties(spark)
    assert df.count() == len(PROPERTIES) == 43 and len({p.key for p in PROPERTIES}) == 43
    assert sum(p.radar for p in PROPERTIES) == 13


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_text(spark):
    assert one(spark, X.compact_spaces, " a ™\t1 ~ 2 ±3 ℃\x01b ") == "a TM 1-2 +/-3 °C b"
    numbers = spark.createDataFrame([(0.0012345,), (1234567.0,), (12.0,), (None,)], "v double").select(X.significant(F.col("v")))
    assert [r[0] for r in numbers.collect()] == ["0.00123", "1.23e+06", "12", None]
    names = ["logo_x.pdf", "A_DE.pdf", "A_EN.pdf", "a_de.pdf"]
    assert [one(spark, X.skip_reason, n) for n in names] == ["non_material_or_auxiliary", "non_english_duplicate", "", ""]
    text = "Intro\nTrade Name \n  PLA  Tough 3D Printing Filament\nmore"
    assert one(spark, lambda c: X.product_from_text(c, F.lit("file")), text) == "PLA Tough"
    assert one(spark, lambda c: X.product_from_text(c, F.lit("file")), "nothing") == "file"
    assert one(spark, lambda c: X.product_from_file(c, F.lit("eSUN")), "eSUN - PLA_Plus TDS v1.2.pdf") == "PLA Plus"
    assert one(spark, lambda c: X.append_flag(c, F.lit("b")), "a;b;") == "a;b"
    assert one(spark, C.method, "per iso 527-2 and DSC") == "ISO 527-2" and one(spark, C.method, "by dsc") == "DSC"


def test_status(spark):
    rows = [("", "boom", "", 0, 1, "x", 0), ("", None, "we value your privacy " * 9, 0, 1, "Fiberlogy", 0), ("", None, "", 0, 9, "Fiberlogy", 0), ("", None, "short", 0, 1, "x", 0), ("", None, "t" * 90, 0, 1, "x", 0), ("", None, "t" * 90, 0, 1, "x", 2), ("why", "boom", "", 0, 1, "x", 0)]
    df = spark.createDataFrame(rows, "skip string, error string, text string, n int, pages int, s string, obs int")
    got = df.select(X.record_status(F.col("error"), F.col("text"), F.col("n"), F.col("pages"), F.col("s"), F.col("obs"), F.col("skip"))).collect()
    assert [r[0] for r in got] == ["error", "skipped", "skipped", "needs_ocr", "no_properties_found", "parsed", "skipped"]


def test_sidecars_profiles_manifest(spark, tmp_path):
    (tmp_path / "ocr.json").write_text(json.dumps({"entries": {"a.pdf": {"mode": "image", "text": "t", "rows": ["Density | 1.2 g/cm3", " "]}, "b.pdf": "plain"}}))
    side = R.ocr_sidecar(spark, str(tmp_path / "ocr.json"))
    assert {r.source_file: (r.ocr_text, r.ocr_rows, r.mode) for r in side.collect()} == {"a.pdf": ("t", ["Density | 1.2 g/cm3"], "image"), "b.pdf": ("plain", [], "ocr_override")}
    docs = spark.createDataFrame([("a.pdf", "", [], None), ("b.pdf", "x" * 90, [], None), ("c.pdf", "", [], "err")], "source_file string, text string, rows array<string>, error string")
    assert {r.source_file: len(r.rows) for r in R.with_ocr(docs, side).collect()} == {"a.pdf": 1, "b.pdf": 0, "c.pdf": 0}
    raw = spark.createDataFrame([("p", '{"filament_density": ["1.24"], "nozzle_temperature": 220, "cool_plate_temp": []}'), ("q", "{bad"), ("r", "[1]")], "material_id string, json string")
    got = {(r.material_id, r.property_key, r.raw_value): (r.value_nominal, r.quality_flag) for r in R.profiles(raw).collect()}
    assert got == {("p", "density", "1.24"): (1.24, "profile_value"), ("p", "nozzle_temperature", "220"): (220.0, "profile_value"), ("p", "bed_temperature", "[]"): (None, "non_numeric")}
    (tmp_path / "m.csv").write_text('local_path,source_page_url\r\n"a\\b.pdf","x ""1"""\r\n,\r\na/b.pdf,later\r\n')
    (row,) = R.manifest(spark, [str(tmp_path / "none.csv"), str(tmp_path / "m.csv")]).collect()
    assert (row.path_key, row.source_page_url) == ("a/b.pdf", "later")
    xml = spark.createDataFrame([("s", "<urlset xmlns='n'><url><loc> http://a/1 </loc></url><x:loc>http://a/2</x:loc></urlset>")], "url string, xml string")
    assert [r.loc for r in R.sitemap(xml).collect()] == ["http://a/1", "http://a/2"]


def test_detection_and_suppression(spark):
    rows = detection_rows(spark, "/root/testdata/sf0.001")
    found = I.detect(rows)
    kinds = {r.issue_type for r in found.collect()}
    assert "test_method_code_captured_as_property_value" not in kinds and "vicat_method_and_load_captured_as_temperature" in kinds
    assert all(r.issue_id[0] in "HMU" and len(r.issue_id) == 14 for r in found.collect())
    assert K.issue_examples(found).groupBy("issue_type").count().agg(F.max("count")).first()[0] <= 10


def test_audit(spark):
    base = {"supplier": "s", "product": "p", "base_material": "", "material_family": "", "source_file": "f.pdf", "raw_value": "", "value_nominal": None, "property_label": "", "raw_label": "", "unit_canonical": "", "test_method": "", "source_context": "", "quality_flag": ""}
    cases = [
        dict(property_key="density", raw_value="3", value_nominal=3.0, source_context="g/cm3"), dict(property_key="density", value_nominal=7.0, product="Bronzefill"), dict(property_key="bed_temperature", value_nominal=200.0),
        dict(property_key="impact_izod", value_nominal=5.0, unit_canonical="kJ/m2", quality_flag="unit_not_converted"), dict(property_key="impact_charpy", value_nominal=5.0, unit_canonical="kJ/m2", raw_label="Charpy", test_method="ISO 180"),
        dict(property_key="impact_charpy", value_nominal=5.0, unit_canonical="kJ/m2", test_method="ASTM D256", quality_flag="impact_method_unit_mismatch:x"),
        dict(property_key="density", value_nominal=1.24, supplier="Prusa Polymers", source_file="1_PLA_Prusament_TDS_2022_EN.pdf"),
    ]
    fields = ", ".join(f"{k} {'double' if k == 'value_nominal' else 'string'}" for k in [*base, "property_key"])
    obs = spark.createDataFrame([tuple({**base, **c}[k] for k in [*base, "property_key"]) for c in cases], fields)
    files = spark.createDataFrame([("f.pdf",)], "source_file string")
    mats = spark.createDataFrame([("s", "p", "f.pdf"), ("s", "q", "gone.pdf"), ("s", "r", "https://x")], "supplier string, product string, source_file string")
    kinds = sorted(r.kind for r in A.audit(mats, obs, files).collect())
    assert kinds == sorted(["missing_source_path", "unit_exponent_capture", "outside_strict_range", "outside_strict_range", "impact_unit_not_converted", "impact_key_unit_family_mismatch", "missing_golden_record"])


def test_sinks(spark, tmp_path):
    mats = spark.createDataFrame([("m", "PLA", ["a"]), ("n", "ABS", None)], "material_id string, product string, modifiers array<string>")
    obs = spark.createDataFrame([("m", 2, "density", 1.2), ("m", 1, "hdt", 60.0)], "material_id string, ordinal long, property_key string, value double")
    K.write_tables(mats, properties(spark), obs, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/observations")).count() == 2
    K.write_json(K.nested(mats, obs), str(tmp_path / "doc"))
    got = {r.material_id: [o.property_key for o in r.observations] for r in spark.read.json(str(tmp_path / "doc")).collect()}
    assert got == {"m": ["hdt", "density"], "n": []}
    K.write_csv(K.long_rows(mats, obs), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Density | 1.27 g/cm3", None)], "material_id string, text string, rows array<string>")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    extract_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.value_nominal for r in spark.read.parquet(str(tmp_path / "out/observations")).collect()] == [1.27]


def test_display(spark):
    from strandline.functions import display as D

    v = spark.createDataFrame([(1234.56,), (123.45678,), (12.3,), (1.5,), (0.1200,), (None,)], "v double")
    assert [r[0] for r in v.select(D.value_text(F.col("v"))).collect()] == ["1235", "123.5", "12.30", "1.5", "0.12", ""]
    assert [r[0] for r in v.select(D.axis_text(F.col("v"))).collect()] == ["1235", "123.5", "12.3", "1.5", "0.12", ""]
    assert [r[0] for r in v.select(D.util_color(F.col("v") / 10)).collect()][2:4] == ["rgb(185 70 84)" if 1.23 > 1.35 else "rgb(204 89 97)", "rgb(151 211 139)"]
    assert one(spark, D.short_metric, "Bed / build plate temperature") == "Bed/build plate" and one(spark, lambda c: D.clipped(c), "x" * 20) == "x" * 17 + "..."
    row = v.limit(1).select(D.ticks(F.lit(0.0), F.lit(10.0), 400, 100), D.radar_point(F.lit(1), 4, F.lit(0.5), 10.0), D.quality_notes(F.lit("unit_converted:psi->MPa;unit_not_converted"), F.lit("5"), F.lit("psi"))).first()
    assert row[0] == [0.0, 2.5, 5.0, 7.5, 10.0] and abs(row[1].x - 5) < 1e-9 and abs(row[1].y) < 1e-9
    assert row[2] == ["Converted from source value 5 psi (psi to MPa) for metric comparison.", "The source's unit could not be converted safely."]


def test_collecting(spark):
    from strandline.sources import collect as L

    df = spark.createDataFrame([("ColorFabb", "https://c/filaments/materials/pla", ""), ("ColorFabb", "https://c/filaments/effects/pla", ""), ("SUNLU", "https://s/products/pla", ""), ("SUNLU", "https://s/products/pla-dryer", ""), ("MatterHackers", "https://m/store/l/abs", ""), ("SUNLU", "https://s/store/l/abs", "")], "v string, u string, t string")
    assert [r[0] for r in df.select(L.is_product_page(F.col("v"), F.col("u"), F.col("t"))).collect()] == [True, False, True, False, True, False]
    links = spark.createDataFrame([("TDS", "https://a/x.pdf"), ("SDS tds", "https://a/x.pdf"), ("TDS", "https://a/x.html"), ("", "https://a/f?filename=tds_pla")], "t string, u string")
    assert [r[0] for r in links.select(L.is_datasheet_link(F.col("t"), F.col("u"))).collect()] == [True, False, False, True]
    assert one(spark, L.ascii_filename, "Caf%C3%A9 / PLA*.pdf") == "Cafe PLA .pdf" and one(spark, L.ascii_filename, "///") == "document"
    assert links.limit(1).select(L.datasheet_label(F.lit("PLA"), F.lit("Download PLA"), F.lit("https://a/PLA_x.pdf"))).first()[0] == "PLA PLA PLA x technical_datasheet"
    names = spark.createDataFrame([("a.pdf", 1), ("a.pdf", 2), ("b", 3)], "name string, ord int")
    assert sorted(r.unique_name for r in L.unique_names(names).collect()) == ["a (2).pdf", "a.pdf", "b"]
    page = spark.createDataFrame([("u", '<li data-label="PLA CF"><input name="amshopby[material][]"></li><li data-label="pla cf"><input name="amshopby[material][]"></li>')], "url string, html string")
    assert [(r.label, r.facet_url) for r in L.material_facets(page).collect()] == [("PLA CF", "https://colorfabb.us/filaments/pla_cf")]
    assert L.worklist(spark.createDataFrame([("SUNLU", "open"), ("X", "open"), ("Y", "done")], "vendor string, status string"), ["open"]).select("product_limit").collect() == [(30,), (25,)]
