"""Charsets, radar rings, property subsets and tolerant loads on small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import units as U
from strandline.operators import radar as R
from strandline.sources import encoding as E
from strandline.sources import readers


@pytest.mark.parametrize(
    "body, header, want",
    [
        ("é€".encode(), None, ("é€", "utf-8")),
        ("é".encode("latin-1"), None, ("é", "cp1252")),
        ("“x”".encode("cp1252"), "text/html; charset=ISO-8859-1", ("“x”", "cp1252")),
        (b"\xef\xbb\xbf" + "ü".encode(), "text/html; charset=latin-1", ("ü", "utf-8")),
        (b"\xfe\xff" + "漢".encode("utf-16-be"), None, ("漢", "utf-16-be")),
        ('<meta charset="koi8-r">'.encode() + "да".encode("koi8-r"), "text/html; charset=none-such", ('<meta charset="koi8-r">да', "koi8-r")),
        ("<meta http-equiv=x content='text/html; charset=shift_jis'>".encode() + "日".encode("shift_jis"), "", ("<meta http-equiv=x content='text/html; charset=shift_jis'>日", "shift_jis")),
        ("é".encode("latin-1"), "text/html; charset=utf-8", ("é", "cp1252")),  # the header is wrong
        (b"\x81\xff", None, ("\x81ÿ", "latin-1")),
        (b"", None, ("", "utf-8")),
        (None, "x", (None, None)),
    ],
)
def test_charsets(spark, body, header, want):
    row = spark.createDataFrame([(body, header)], "b binary, h string").select(E.page_text(F.col("b"), F.col("h")).alias("d")).first()
    assert tuple(row.d) == want


def test_ring(spark):
    values = [("all", "a", 10.0), ("all", "b", 5.0), ("all", "c", 0.0), ("gap", "a", 0.0), ("gap", "c", 4.0), ("one", "b", 5.0), ("none", "d", 1.0), ("all", "e", None)]
    stat = spark.createDataFrame(values, "series string, property_key string, value double")
    span = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0), ("c", 0.0, 8.0), ("d", 1.0, 1.0), ("e", 0.0, 1.0), ("f", 0.0, 1.0)], "property_key string, lo double, hi double")
    axes = R.kept_axes(stat, span, ["b", "a", "d", "e", "f", "c"])
    assert [a.key for a in axes.first().axes] == ["b", "a", "c"]  # d is a point, e has no number, f no series
    rings = {r.series: r for r in R.rings(stat, axes, 100.0).collect()}
    assert rings["all"].complete and [round(p.norm, 3) for p in rings["all"].points] == [0.5, 1.0, 0.0]
    assert (round(rings["all"].points[0].x, 6) + 0, round(rings["all"].points[0].y, 6)) == (0, -50)
    assert (rings["gap"].missing, rings["one"].missing, rings["none"].missing) == (1, 2, 3)
    found = sorted((r.series, r.i, r.from_key, r.to_key) for r in R.segments(R.rings(stat, axes)).collect())
    assert found == [("all", 0, "b", "a"), ("all", 1, "a", "c"), ("all", 2, "c", "b"), ("gap", 1, "a", "c")]
    assert "Window" not in R.segments(R.rings(stat, axes))._jdf.queryExecution().executedPlan().toString()
    many = spark.createDataFrame([("s", f"k{i:02}", float(i)) for i in range(15)], "series string, property_key string, value double")
    wide = many.selectExpr("property_key", "0.0D AS lo", "20.0D AS hi")
    assert [a.key for a in R.kept_axes(many, wide, [f"k{i:02}" for i in range(14, -1, -1)]).first().axes] == [f"k{i:02}" for i in range(14, 4, -1)]
    assert R.segments(R.rings(stat.where("false"), axes)).collect() == []


def test_subsets_keep_their_order(spark):
    stat = spark.createDataFrame([("m", "x", 1.0), ("m", "y", 2.0), ("n", "z", 3.0)], "material_id string, property_key string, mean_value double")
    got = sorted((r.material_id, r.subset, r.ord, r.property_key) for r in R.subsets(stat, {"p": ["y", "q", "x"], "r": ["z"]}).collect())
    assert got == [("m", "p", 0, "y"), ("m", "p", 2, "x"), ("n", "r", 0, "z")]


def test_tolerant_load(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    assert [r.status for r in readers.loaded(spark, str(root), ["x.json"])[2].collect()] == ["missing"]
    (root / "deep").mkdir(parents=True)
    (root / "good.json").write_text('{"materials": [{"material_id": "m1", "product": "PLA", "observations": [{"property_key": "density", "value_nominal": 1.2}, {"value_nominal": "bad"}]}, {"material_id": 2}]}')
    (root / "deep" / "list.json").write_text('{"materials": {"a": 1}}')
    (root / "cut.json").write_text('{"materials": [')
    (root / "empty.json").write_text("")
    (root / "other.txt").write_text("{}")
    mats, obs, status = readers.loaded(spark, str(root), ["good.json", "gone.json"])
    assert sorted((r.file, r.status, r.materials) for r in status.collect()) == [
        ("cut.json", "broken", 0), ("deep/list.json", "no_materials", 0), ("empty.json", "broken", 0), ("gone.json", "missing", 0), ("good.json", "ok", 2),
    ]
    assert sorted((r.material_id, r.product) for r in mats.collect()) == [("2", None), ("m1", "PLA")]
    assert sorted((r.property_key or "", r.value_nominal or 0) for r in obs.collect()) == [("", 0), ("density", 1.2)]


def test_small_numbers(spark):
    row = spark.sql("SELECT '3.5' AS a, '-1' AS b, 'x' AS c, 20.0D AS d, 25.0D AS e, timestamp'2024-05-06 07:08:09' AS t").select(
        *[U.positive_or(F.col(c), F.lit(9.0)).alias(c) for c in "abc"], U.is_major(F.col("d")).alias("d"), U.is_major(F.col("e")).alias("e"), U.iso_day(F.col("t")).alias("t")
    )
    assert tuple(row.first()) == (3.5, 9.0, 9.0, True, False, "2024-05-06")
    assert math.isclose(R.RADIUS, 122)
