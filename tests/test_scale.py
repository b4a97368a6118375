"""Operators that bin, bucket and combine agree with plain versions, and no window holds a whole property, model or vendor."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import beam as B
from strandline.operators import prices as P
from strandline.operators import stats as S


@pytest.mark.parametrize("per_octave", [1, 1024])
def test_quantiles_against_numpy(spark, monkeypatch, per_octave):
    rng = np.random.default_rng(per_octave)
    values = {"a": rng.normal(0, 100, 700).round(1), "b": np.repeat(1.24, 50), "c": np.r_[rng.normal(5, 1e-9, 99), -7.0], "d": np.array([3.0]), None: rng.integers(-3, 3, 90) * 1.0}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "property_key string, value double")
    monkeypatch.setattr(S.bucket, "__defaults__", (per_octave,))
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "hi": 1.0}
    got = {r.property_key: r for r in S.quantiles(df, ["property_key"], "value", probs).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert [got[k][n] for n in probs] == pytest.approx([float(np.quantile(v, p)) for p in probs.values()], abs=1e-12)


def test_first_wins_is_the_first_of_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), i, f"row {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, i int, t string")
    got = {(r.k): (r.o, r.i, r.t) for r in S.first_wins(df, ["k"], [F.col("o"), -F.col("i")]).collect()}
    want = {}
    for k, o, i, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2])):
        want.setdefault(k, (o, i, t))
    assert got == want


def test_nearest_by_trying_all(spark):
    rng = random.Random(2)
    nodes = [(m, i, round(rng.uniform(-40, 40), 1)) for m in "ab" for i in range(25)] + [("far", 0, 500.0), ("c", 1, 0.0), ("c", 0, 0.0)]
    points = [(m, i, round(rng.uniform(-60, 60), 1)) for m in ("a", "b", "far", "c", "none") for i in range(30)]
    got = {(r.model, r.id): (r.idx, round(r.distance, 6)) for r in B.nearest(spark.createDataFrame(points, "model string, id long, x double"), spark.createDataFrame(nodes, "model string, idx long, node_x double"), 7.0).collect()}
    want = {}
    for m, i, x in points:
        own = [(abs(n - x), k) for o, k, n in nodes if o == m]
        if own:
            d, k = min(own)
            want[m, i] = (k, round(d, 6))
    assert got == want


def test_overlaps_and_sections_by_trying_all(spark):
    rng = random.Random(3)
    el = [("m", i, i * 1.5, i * 1.5 + 1.5) for i in range(30)]
    loads = [("m", i, *(round(rng.uniform(-10, 60), 2) for _ in range(2))) for i in range(20)]
    got = {(r.el, r.id): round(r.overlap, 6) for r in B.overlaps(spark.createDataFrame(el, "model string, el long, a double, b double"), spark.createDataFrame(loads, "model string, id long, x1 double, x2 double"), 4.0).collect()}
    want = {(e, i): round(min(b, max(x, y)) - max(a, min(x, y)), 6) for _, e, a, b in el for _, i, x, y in loads if min(b, max(x, y)) > max(a, min(x, y))}
    assert got == want
    edges = [("p", 0.0, 0.0, 40.0, 0.0), ("p", 40.0, 0.0, 40.0, 9.0), ("p", 40.0, 9.0, 17.0, 3.0), ("p", 17.0, 3.0, 0.0, 9.0), ("p", 0.0, 9.0, 0.0, 0.0)]
    cuts = [("p", x / 2) for x in range(-3, 90)]
    made = {r.x: r.total for r in B.cross_sections(spark.createDataFrame(edges, "model string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(cuts, "model string, x double"), 4.0).collect()}
    for _, x in cuts:
        if 0 <= x < 40:
            top = 9 - (9 - 3) * x / 17 if x < 17 else 3 + 6 * (x - 17) / 23
            assert made.pop(x) == pytest.approx(top)
    assert not made


def test_candidates_of_a_large_vendor(spark):
    rows = [("v", f"u{i:04d}", "sitemap" if i % 7 else "html_sidecar") for i in range(500)] + [("w", "u", "seed")]
    limits = spark.createDataFrame([("v", 90)], "vendor string, product_limit int")
    got = P.capped_candidates(spark.createDataFrame(rows, "vendor string, url string, source string"), limits).collect()
    order = sorted((s != "html_sidecar", u) for v, u, s in rows if v == "v")[:90]
    assert {r.url for r in got if r.vendor == "v"} == {u for _, u in order} and len(got) == 91


def windows(df):
    """The partition keys of each window in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.split("[")[-2 if "ORDER" in line else -1] for line in plan.splitlines() if line.strip(" :+-").startswith("Window ")], plan


def test_no_window_ranks_values_of_a_whole_property(spark):
    df = spark.createDataFrame([("a", 1.0)], "property_key string, value double")
    _, plan = windows(S.quantiles(df, ["property_key"], "value", {"m": 0.5}))
    ranked = [line for line in plan.splitlines() if "Window " in line and "value#" in line.split("windowspecdefinition")[-1] and "ASC" in line]
    assert ranked and all("__b#" in line for line in ranked)


def test_first_wins_and_checks_scan_once(spark):
    """First-wins keeps one row a task before the shuffle and needs no sorted aggregate; strict checks read observations once."""
    from strandline.operators import audit, stats

    rows = spark.range(1000).selectExpr("id % 7 AS k", "id AS o", "cast(id AS string) AS v")
    shape = stats.first_wins(rows, ["k"], [F.col("o")])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in shape and shape.count("WindowGroupLimit") == 2
    fields = "supplier string, product string, source_file string, base_material string, material_family string, property_key string, property_label string, raw_label string, raw_value string, value_nominal double, unit_canonical string, test_method string, source_context string, quality_flag string"
    obs = spark.createDataFrame([("Prusa Polymers", "PLA", "1_PLA_Prusament_TDS_2022_EN.pdf", "PLA", "PLA", "density", "Density", "", "3", 3.0, "g/cm3", "", "g/cm3", "")], fields)
    materials = obs.select("supplier", "product", "source_file")
    found = audit.audit(materials, obs, materials)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("value_nominal#") > 0
    assert sorted(r.kind for r in found.collect()) == ["golden_density_exponent", "golden_density_mismatch", "missing_golden_record", "outside_strict_range", "unit_exponent_capture"]
