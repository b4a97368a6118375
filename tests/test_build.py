import json

import pytest
from pyspark.sql import functions as F

from strandline.sources import build as B
from strandline.sources import sinks as K

DOC = "source_file string, text string, rows array<string>, pages int, error string"
LONG = "Density | 1.24 g/cm3 | ISO 1183\n" + "words of a datasheet " * 20
DOCS = [
    ("Prusa Polymers/PLA Blend_TDS.pdf", LONG, ["Tensile strength | 50 MPa | ISO 527"], 2, None),
    ("SUNLU/PETG.pdf", "", ["Density | 1.27 g/cm3"], 1, None),
    ("SUNLU/empty.pdf", "", [], 1, None),
    ("SUNLU/none.pdf", "words without numbers " * 20, [], 1, None),
    ("SUNLU/broken.pdf", "", [], None, "no file"),
    ("SUNLU/logo.pdf", LONG, [], 1, None),
    ("SUNLU/ABS_DE.pdf", LONG, [], 1, None),
]


@pytest.fixture(scope="module")
def made(spark):
    specs = spark.createDataFrame([("Vendor", "PLA Silk", "https://v/p", "", ["Density | 1.31 g/cm3"])], "supplier string, product string, source_file string, text string, rows array<string>")
    slicer = spark.createDataFrame([("Bambu/x.json", json.dumps({"filament_density": ["1.26"]})), ("Bambu/y.json", "{}"), ("Bambu/z.json", "not json")], "source_file string, json string")
    return B.build(spark.createDataFrame(DOCS, DOC), specs, slicer)


def test_records_and_statuses(made):
    got = {r.source_file: r for r in made["materials"].collect()}
    assert {f: r.status for f, r in got.items()} == {
        DOCS[0][0]: "parsed", DOCS[1][0]: "parsed", DOCS[2][0]: "needs_ocr", DOCS[3][0]: "no_properties_found", DOCS[4][0]: "error", DOCS[5][0]: "skipped", DOCS[6][0]: "skipped",
        "https://v/p": "parsed", "Bambu/x.json": "parsed",
    }
    assert got["https://v/p"].product == "PLA Silk" and got[DOCS[1][0]].base_material == "PETG" and got[DOCS[4][0]].quality_notes == "no file"
    assert got[DOCS[0][0]].supplier == "Prusa Polymers" and len({r.material_id for r in got.values()}) == len(got)


def test_observations_of_all_kinds(made):
    ids = {r.material_id: r.source_file for r in made["materials"].collect()}
    got = sorted((ids[r.material_id], r.property_key, r.value_nominal) for r in made["observations"].collect())
    want = [(DOCS[0][0], "density", 1.24), (DOCS[0][0], "tensile_strength", 50.0), (DOCS[1][0], "density", 1.27), ("https://v/p", "density", 1.31), ("Bambu/x.json", "density", 1.26)]
    assert got == sorted(want)


def test_publication(spark, made, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(ValueError):
        K.pointed(spark, str(tmp_path))
    first = B.publish(made, path)
    assert K.pointed(spark, path) == first and B.published(spark, path)["observations"].count() == 5
    broken = made | {"materials": made["materials"].limit(1)}
    with pytest.raises(ValueError, match="without a material"):
        B.publish(broken, path)
    assert K.pointed(spark, path) == first  # what is read stays as it was
    second = B.publish(made | {"observations": made["observations"].where("property_key = 'density'")}, path)
    tables = B.published(spark, path)
    assert K.pointed(spark, path) == second and tables["observations"].count() == 4
    assert {r.property_key: r.materials for r in tables["coverage"].where("materials > 0").collect()} == {"density": 4}


def test_tables_are_replaced_only_when_verified(spark, made, tmp_path):
    path = str(tmp_path / "db")
    for _ in range(2):
        K.write_tables(made["materials"], made["property_definitions"], made["observations"], path)
    with pytest.raises(ValueError):
        K.write_tables(made["materials"].unionByName(made["materials"]), made["property_definitions"], made["observations"], path)
    assert spark.read.parquet(f"{path}/observations").count() == 5 and not [p for p in tmp_path.iterdir() if "__old" in p.name]


def test_price_outputs(spark, tmp_path):
    prices = spark.createDataFrame([("v", "u1", "p", 10.0, "EUR", 1.0, 11.0), ("v", "u2", "q", 5.0, "EUR", None, None)], "vendor string, url string, product string, price double, currency string, mass_kg double, price_usd double")
    log = spark.createDataFrame([("fetch", "ok"), ("fetch", "ok"), ("parse", "empty")], "action string, status string")
    row = K.price_summary(prices, log).first()
    assert (row.price_rows, row.with_mass, row.statuses) == (2, 1, {"fetch:ok": 2, "parse:empty": 1})
    path = str(tmp_path / "prices")
    assert K.append_prices(prices.where("url = 'u1'"), path).count() == 1
    assert K.append_prices(prices, path).count() == 2  # the run goes on where it broke off
    assert K.append_prices(prices, path).count() == 2


def test_issue_report(spark):
    rows = [("H-1", "high", "t1", "s", "p|q", "density", "3", "ctx"), ("H-2", "high", "t1", "s", "p", "density", "4", "ctx"), ("M-1", "medium", "t2", "s", "p", "hdt", "5", "ctx")]
    issues = spark.createDataFrame(rows, "issue_id string, confidence string, issue_type string, supplier string, product string, property_key string, raw_value string, source_context string").withColumn("material_id", F.lit("m"))
    text = K.issue_report(issues)
    assert "| high | t1 | 2 | 1 |" in text and "p/q" in text and text.index("## t1") < text.index("## t2")


def test_running_ids_and_flat_files(spark, made, tmp_path):
    path = str(tmp_path / "set")
    B.publish(made, path)
    read = B.published(spark, path)
    ids = [r.observation_id for r in read["observations"].orderBy("observation_id").collect()]
    files = {r.material_id: (r.source_type, r.source_file) for r in read["materials"].collect()}
    order = [files[r.material_id] for r in read["observations"].orderBy("observation_id").collect()]
    assert ids == list(range(1, 6)) and order == sorted(order, key=lambda f: (["pdf", "json_profile", "html_spec"].index(f[0]), f[1]))
    B.export(read, str(tmp_path / "flat"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/flat/long").count() == 5
    assert spark.read.json(f"{tmp_path}/flat/nested").count() == 9
    assert "density" in spark.read.text(f"{tmp_path}/flat/coverage", wholetext=True).first()[0]
