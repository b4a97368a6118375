"""Crawls, harvests, product documents, running ids and growing outputs, against small cases worked out by hand."""

import json
import os
import subprocess
import sys
import time

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from strandline.operators.ordinals import running_ids
from strandline.sources import crawl as K
from strandline.sources import harvest as H
from strandline.sources import product_json as J
from strandline.streaming import outputs as O


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_ids(spark):
    rows = spark.createDataFrame([(i % 7, str(i)) for i in range(1000)], "k long, v string").repartition(5)
    made = running_ids(rows, [F.col("k").desc(), F.col("v")], "id")
    got = [(r.k, r.v, r.id) for r in made.orderBy("id").collect()]
    assert got == [(k, v, i + 1) for i, (k, v) in enumerate(sorted(((i % 7, str(i)) for i in range(1000)), key=lambda x: (-x[0], x[1])))]
    assert "Window" not in plan(made) and "SinglePartition" not in plan(made)
    ties = running_ids(spark.range(50).select(F.lit(1).alias("k")), [F.col("k")], "id", first=0)
    assert sorted(r.id for r in ties.collect()) == list(range(50))
    assert running_ids(rows.where("k > 100"), [F.col("k")], "id").collect() == []


SPEC = "<h1>Maker PLA {0}</h1><table><tr><td>Density</td><td>1.2{0} g/cm3</td></tr></table>"


def link(name, text="x"):
    return f'<a href="/products/pla-{name}">{text}</a>'


@pytest.fixture(scope="module")
def run(spark):
    pages = [
        ("https://a.com/shop?page=1", "<h1>Seed</h1>" + link(1) + link(2) + link(1) + link("lost") + '<a href="/products/nozzle-pla">n</a>'),
        ("https://a.com/products/pla-1?ref=q", SPEC.format(1) + link(3) + link(2) + '<a href="/f/tds-1.pdf">TDS</a><a href="/f/sds-1.pdf">Safety data</a>'),
        ("https://a.com/products/pla-2", "<h1>Maker PLA two</h1>" + link(1) + '<a href="/f/tds-1.pdf">TDS</a>'),
        ("https://a.com/products/pla-3", SPEC.format(3) + link(4) + link(5)),
        ("https://a.com/products/pla-4", SPEC.format(4)),
        ("https://a.com/products/pla-5", SPEC.format(5)),
        ("https://b.com/", '<h1>B</h1><a href="https://a.com/products/pla-1#top">PLA</a>'),
        ("https://b.com/?z=1", "<h1>B again</h1>"),
    ]
    seeds = [("A", "https://a.com/shop", 1), ("A", "https://a.com/shop#x", 0), ("B", "https://b.com", 0), ("C", "https://c.com/gone", 0)]
    return K.crawl(
        spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(seeds, "vendor string, url string, place int"),
        spark.createDataFrame([("A", 5)], "vendor string, product_limit int"), rounds=5,
    )


def test_crawl_visits(run):
    got = sorted((r.vendor, r.round, r.place, r.url.split("/")[-1], r.found) for r in run.visits.collect())
    assert got == [
        ("A", 0, 0, "shop", True), ("A", 1, 1, "pla-1", True), ("A", 1, 2, "pla-2", True), ("A", 1, 3, "pla-lost", False), ("A", 2, 1, "pla-3", True), ("A", 3, 1, "pla-4", True),
        ("B", 0, 0, "", True), ("B", 1, 1, "pla-1", True), ("B", 2, 1, "pla-3", True), ("B", 2, 2, "pla-2", True), ("B", 3, 1, "pla-4", True), ("B", 3, 2, "pla-5", True),
        ("C", 0, 0, "gone", False),
    ]


def test_crawl_entries_and_log(run):
    entries = {r.source_url.split("/")[-1]: r for r in run.entries.collect()}
    assert {k: r.supplier for k, r in entries.items()} == {"pla-1": "A", "pla-3": "A", "pla-4": "A", "pla-5": "B"}
    assert entries["pla-1"].text == "\n".join(["Maker PLA 1", *entries["pla-1"].rows]) and "1.21 g/cm3" in entries["pla-1"].rows[0]
    assert {r.source_file for r in run.snapshots.collect()} == {r.source_file for r in entries.values()}
    assert sorted((r.vendor, r.url) for r in run.datasheets.collect()) == [("A", "https://a.com/f/tds-1.pdf"), ("B", "https://a.com/f/tds-1.pdf")]
    counts = {(r.vendor, r.action, r.status): r.n for r in K.summary(run).collect()}
    assert counts == {
        ("A", "fetch_seed", "ok"): 1, ("B", "fetch_seed", "ok"): 1, ("C", "fetch_seed", "error"): 1, ("A", "fetch_product", "ok"): 4, ("A", "fetch_product", "error"): 1,
        ("B", "fetch_product", "ok"): 5, ("A", "extract_html_specs", "saved"): 3, ("A", "extract_html_specs", "no_rows"): 1, ("B", "extract_html_specs", "saved"): 1,
        ("B", "extract_html_specs", "no_rows"): 1, ("B", "extract_html_specs", "duplicate"): 3, ("A", "datasheet_link", "found"): 1, ("B", "datasheet_link", "found"): 1,
    }


def test_crawl_outputs(spark, run, tmp_path):
    K.write_run(run, str(tmp_path), "2024-01-01")
    assert spark.read.json(f"{tmp_path}/entries").where("generated_at = '2024-01-01'").count() == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/run_log").count() == run.log.count()
    by = {r.vendor: r.statuses for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert by["C"]["fetch_seed:error"] == 1 and by["B"]["extract_html_specs:duplicate"] == 3


def test_harvest_is_one_pass(spark, tmp_path):
    pages = [
        ("https://s-1.x/products/pla-1", '<title>PLA one 1 kg</title><a href="/products/petg-9">PETG</a><a href="/cart">c</a><script>x={"variants": [{"price": 1999, "title": "Red"}, {"price": 1999, "title": "Red"}, {"price": null}]}</script>'),
        ("https://s-1.x/products/pla-2", "<title>nothing</title>"),
        ("https://s-2.x/", None),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    shape = plan(H.tagged(df, F.lit("v"), F.lit(False)))
    assert shape.count("MapInArrow") == 1 and "Exchange" not in shape and "Union" not in shape
    got = H.harvest(df, F.regexp_extract("url", r"//([^.]*)", 1), F.lit(False), str(tmp_path / "h"))
    assert [(r.vendor, r.link, r.hint) for r in got.candidates.collect()] == [("s-1", "https://s-1.x/products/petg-9", "PETG")]
    assert [(r.price, r.variant) for r in got.offers.orderBy("ord").collect()] == [("19.99", "Red"), ("19.99", "Red")]
    log = sorted((r.url.split("/")[-1], r.action, r.status, r.detail) for r in got.log.collect())
    assert log[2:4] == [("pla-1", "fetch_product", "priced", "1 offers; title=PLA one 1 kg"), ("pla-1", "page_links", "ok", "1 product links")]
    assert {r.action_status: r.n for r in H.statuses(got.log).collect()} == {"fetch_product:priced": 1, "fetch_product:no_price": 2, "page_links:ok": 3}
    assert "tag=offer" in " ".join(got.offers.inputFiles()) and "PartitionFilters: [isnotnull(tag" in plan(got.offers)


def test_product_documents(spark):
    good = {"title": " PLA  Basic ", "description": "<ul><li>Spool weight: 1 kg</li><li>Package weight: 3 kg</li></ul>", "variants": [
        {"price": 2999, "title": "Red", "available": True, "sku": 12}, {"price": "19.50", "name": "", "public_title": "Blue 500 g", "title": "t"}, {"price": 200, "name": "0", "available": 0},
        {"price": None}, {}, "text", {"price": "no"}, {"price": -3}, {"price": 1e9}, {"price": True, "title": None},
    ]}
    url = "https://x.com/products/pla-basic?variant=1"
    bodies = [
        ("V", url, "application/json", json.dumps(good)), ("V", url, "text/html", json.dumps(good)), ("V", url, "application/json", "{broken"), ("V", url, None, "{}"), ("V", url, "application/json", None),
        ("V", "https://x.com/pages/a", "application/json", json.dumps(good)), ("W", url, "text/javascript", json.dumps({"variants": [{"price": 5, "available": "yes"}]})), ("W", url, "application/json", "[1]"),
    ]
    rows = [(v, u, "Hint", "seed", c, b) for v, u, c, b in bodies]
    got = J.product_rows(spark.createDataFrame(rows, "vendor string, url string, hint string, source string, content_type string, body string"), {"V": "EUR"})
    told = [(r.vendor, r.product, r.variant, r.sku, r.ord, r.price, r.currency, r.mass_kg, r.mass_source, r.price_per_kg, r.availability) for r in got.orderBy("vendor", "ord").collect()]
    assert told[:3] == [
        ("V", "PLA Basic", "Red", "12", 0, 29.99, "EUR", 1.0, "labeled_page_text:1 kg", 29.99, "InStock"),
        ("V", "PLA Basic", "Blue 500 g", "", 1, 19.5, "EUR", 0.5, "variant:500 g", 39.0, "OutOfStock"),
        ("V", "PLA Basic", "0", "", 2, 200.0, "EUR", 1.0, "labeled_page_text:1 kg", 200.0, "OutOfStock"),
    ]
    assert told[-1] == ("W", "Hint", "", "", 0, 5.0, "", None, "", None, "InStock")
    assert {(r.vendor, r.detail) for r in J.product_log(got.where("ord < 3")).collect()} == {("V", "3 variants; title=PLA Basic"), ("W", "1 variants; title=Hint")}


PRICE = "vendor string, url string, sku string, variant string, price double, currency string, mass_kg double, product string, price_per_kg double, price_usd double, ord long"


def price_rows(n):
    return [(f"v{i % 2}", f"u{i % 9}", "", f"x{i % 4}", float(i % 3), ("EUR", "USD")[i % 2], 1.0 if i % 3 else None, f"PLA {i % 5}", 1.0 if i % 3 else None, None if i % 4 else 2.0, i) for i in range(n)]


def in_one_run(spark, rows, path):
    O.fold(spark.createDataFrame(rows, PRICE), 0, path)
    return sorted(tuple(r) for r in O.rollup(spark, path).collect())


def test_batches_come_again(spark, tmp_path):
    rows = price_rows(60)
    want = in_one_run(spark, rows, str(tmp_path / "one"))
    path = str(tmp_path / "many")
    assert O.rollup(spark, path) is None
    for k in (0, 1, 1, 2, 0, 2, 3, 3):  # a batch that comes again replaces what it left
        O.fold(spark.createDataFrame(rows[k * 15 : k * 15 + 20], PRICE), k, path)
    assert sorted(tuple(r) for r in O.rollup(spark, path).collect()) == want


def test_stream_stopped_half_way(spark, tmp_path, monkeypatch):
    rows, source, path = price_rows(80), str(tmp_path / "in"), str(tmp_path / "out")
    want = in_one_run(spark, rows, str(tmp_path / "one"))
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], PRICE).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(PRICE).option("maxFilesPerTrigger", 1).parquet(source)
    fold, calls = O.fold, []

    def breaks_off(batch, number, at):
        calls.append(number)
        if number == 2:
            batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # half of a batch's work
            raise RuntimeError("lost")
        fold(batch, number, at)

    monkeypatch.setattr(O, "fold", breaks_off)
    with pytest.raises(Exception, match="lost"):
        O.price_stream(stream(), path, str(tmp_path / "cp")).awaitTermination()
    assert calls == [0, 1, 2]
    monkeypatch.setattr(O, "fold", fold)
    O.price_stream(stream(), path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in O.rollup(spark, path).collect()) == want


def test_scratch_goes_with_the_session(tmp_path):
    code = f"""
import os
from pyspark.sql import SparkSession
from strandline import scratch
base = {str(tmp_path)!r}
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", base).getOrCreate()
own = lambda: [x for d in os.listdir(base) if d.startswith('strandline-') for x in os.listdir(os.path.join(base, d))]
one, two = scratch.written(spark.range(3)), scratch.written(spark.range(4))
assert len(own()) == 2
scratch.drop_table(one)
assert len(own()) == 1 and two.count() == 4
spark.stop()
assert not [d for d in os.listdir(base) if d.startswith('strandline-')]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    killed = code[: code.index("scratch.drop_table")] + "sys.exit()"  # no stop: the folder goes with the JVM
    subprocess.run([sys.executable, "-c", "import sys" + killed], cwd=ROOT, check=True, timeout=120)
    for _ in range(50):
        if not [d for d in os.listdir(tmp_path) if d.startswith("strandline-")]:
            break
        time.sleep(0.2)
    else:
        raise AssertionError(os.listdir(tmp_path))


def test_sidecar_candidates(spark):
    from strandline.sources import readers

    specs = spark.createDataFrame([(" V ", "PLA", "https://v.com/p/?x=1"), ("V", None, "https://v.com/q"), ("", "n", "https://v.com/r"), ("W", "n", None), (None, "n", "u")], "supplier string, product string, source_url string").coalesce(1)
    got = [(r.vendor, r.url, r.hint, r.source) for r in readers.sidecar_candidates(specs).orderBy("place").collect()]
    assert got == [("V", "https://v.com/p", "PLA", "html_material_specs"), ("V", "https://v.com/q", "", "html_material_specs")]


def test_price_rows(spark, tmp_path):
    """Equal offers once, the best of an article, no nameless one beside a named one of its price; other products go."""
    offers = '[{"price": 20, "title": "Red 1kg", "sku": "a"}, {"price": 20, "title": "Red 1kg", "sku": "a"}, {"price": 20, "title": "Red large 2 kg", "sku": "a"}, {"price": 20, "title": ""}, {"price": 30, "title": "", "available": false}]'
    pages = [("https://s.x/products/pla", f'<title>PLA Basic</title><script>x={{"variants": {offers}}}</script>'), ("https://s.x/products/pla-nozzle", f'<title>Nozzle</title><script>x={{"variants": {offers}}}</script>')]
    found = H.harvest(spark.createDataFrame(pages, "url string, html string"), F.lit("S"), F.lit(False), str(tmp_path / "h"))
    rates = spark.createDataFrame([("EUR", 2.0)], "currency string, rate double")
    rows = sorted(H.price_rows(found, rates, F.lit("EUR")).collect(), key=lambda r: r.price)
    assert [(r.product, r.variant, r.sku, r.price, r.currency, r.mass_kg, r.price_per_kg, r.price_usd, r.availability) for r in rows] == [
        ("PLA Basic", "Red large 2 kg", "a", 20.0, "EUR", 2.0, 10.0, 40.0, "InStock"), ("PLA Basic", "", "", 30.0, "EUR", None, None, 60.0, "OutOfStock"),
    ]
