import pyspark.sql.functions as F

from strandline.operators import beam as B
from strandline.operators import detail as D
from strandline.operators import prices as P

OBS = "material_id long, property_key string, category string, value double, ordinal long, test_method string, source_context string"
MAT = "material_id long, supplier string, base_material string"


def test_kpis_of_nothing_and_of_some(spark):
    (row,) = D.kpis(spark.createDataFrame([], MAT), spark.createDataFrame([], OBS), ["a"]).collect()
    assert tuple(row) == (0, 0.0, 0, 0, "No data", 0)
    mats = spark.createDataFrame([(1, "s", "PLA"), (2, "s", None), (3, "", "ABS"), (4, None, "PLA")], MAT)
    obs = spark.createDataFrame([(1, "b", None, 1.0, 1, None, None), (1, "a", None, 1.0, 2, None, None), (2, "b", None, 1.0, 3, None, None), (2, "a", None, 1.0, 4, None, None)], OBS)
    (row,) = D.kpis(mats, obs, ["a", "b"]).collect()
    assert tuple(row) == (4, 50.0, 2, 1, "a", 2)  # a tie goes to the earlier key
    assert [tuple(r) for r in D.legend(mats, obs).collect()] == [("PLA", 1), ("Unknown", 1)]


def test_property_groups(spark):
    obs = spark.createDataFrame(
        [(1, "a", "Own", 1.0, 2, None, None), (1, "a", "Own", 1.0, 1, None, None), (1, "b", "", 1.0, 3, None, None), (1, "c", None, None, 4, None, None), (1, "c", None, None, 5, None, None)], OBS
    )
    known = spark.createDataFrame([("b", "Thermal")], "property_key string, category string")
    made = D.property_groups(obs, known, ["material_id", "property_key", "value"], [F.col("ordinal")])
    assert sorted((r.property_key, r.section, r.place, r.ordinal) for r in made.collect()) == [("a", "Own", 99, 1), ("b", "Thermal", 3, 3), ("c", "Other", 7, 4)]
    scope = spark.createDataFrame([("b",)], "property_key string")
    assert [r.property_key for r in D.property_groups(obs, known, ["material_id", "property_key", "value"], [F.col("ordinal")], scope).collect()] == ["b"]


def test_sources(spark):
    obs = spark.createDataFrame([(1, "a", None, 1.0, i, f"m{i % 20:02}", f"c{i % 7}") for i in range(60)] + [(2, "a", None, 1.0, 1, None, "")], OBS)
    got = {r.material_id: r for r in D.sources_panel(obs).collect()}
    assert got[1].test_method == "; ".join(f"m{i:02}" for i in range(12)) and got[1].source_context == "c0; c1; c2; c3"
    assert got[2].test_method is None and got[2].source_context is None


def test_plot_windows(spark):
    f = lambda x: F.lit(float(x))
    shown = D.shown_range(f(0), f(100), f(90), f(4))
    row = spark.range(1).select(
        shown.alias("edge"), D.shown_range(f(5), f(5), F.lit(None).cast("double"), f(1)).alias("point"),
        D.zoomed(f(0), f(100), shown, f(4), f(0.5), F.lit(False)).alias("out"), D.zoomed(f(0), f(100), shown, f(18), f(2), F.lit(True)).alias("most"),
    ).first()
    assert (row.edge.lo, row.edge.hi) == (75.0, 100.0) and (row.point.lo, row.point.hi) == (5.0, 6.0)
    assert abs(row.out.zoom - 4 / 1.2) < 1e-9 and abs(row.out.center - 85.0) < 1e-9  # moved inside
    assert row.most.zoom == 18.0 and abs(row.most.center - (100 - 100 / 36)) < 1e-9


def test_discovery(spark):
    fields = "vendor string, url string, hint string, source string, place long"
    side = spark.createDataFrame([("v", "https://a/products/1/", None, "html_material_specs", 1)], fields)
    maps = spark.createDataFrame([("v", "https://a/products/1?x=1", "late", "sitemap", 1), ("v", "https://a/products/0", "", "sitemap", 2), ("v", "https://a/products/0#y", "", "sitemap", 3)], fields)
    seeds = spark.createDataFrame([("v", "https://a/products/1", "later", "seed", 1), ("w", "https://b/products/9", "", "seed", 2)], fields)
    limits = spark.createDataFrame([("v", 2)], "vendor string, product_limit int")
    got = sorted((r.vendor, r.url, r.hint, r.source) for r in P.discover([side, maps, seeds], limits).collect())
    assert got == [("v", "https://a/products/0", "", "sitemap"), ("v", "https://a/products/1", "late", "sitemap"), ("w", "https://b/products/9", "", "seed")]
    assert P.discover([side.limit(0)], limits).count() == 0


def test_geometry(spark):
    bounds = spark.createDataFrame([("m", 0.0, 50.0)], "model string, min_x double, max_x double")
    loads = spark.createDataFrame([("m", "p", -4.0, None), ("m", "u", 10.2, 10.4), ("m", "w", 10.0, 80.0)], "model string, id string, x1 double, x2 double")
    assert sorted(tuple(r) for r in B.fitted(loads, bounds).collect()) == [("m", "p", 0.0, None), ("m", "u", 10.2, 10.4), ("m", "w", 10.0, 50.0)]
    assert sorted(r.id for r in B.fitted(loads, bounds, 1.0).collect()) == ["p", "w"]
    view = spark.range(1).select(B.padded(F.lit(0.0), F.lit(100.0), 80, 34, F.lit(2.0)).alias("v")).first().v
    assert (view.lo, view.hi) == (8.0, 92.0)
