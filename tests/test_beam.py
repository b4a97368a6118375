import json

import pytest

from strandline.operators import beam as B


@pytest.fixture(scope="module")
def made(spark):
    cases = B.matrix(B.preset_models(spark), e=3200.0, strength=58.0)
    return {(r.model, r.scenario, r.direction): r for r in B.summary(B.stations(cases)).collect()}


def test_default_beam(made):
    r = made["beam", "realistic", "along"]
    assert r.max_deflection == pytest.approx(0.4763, abs=2e-4) and r.max_stress == pytest.approx(6.999, abs=2e-3)
    assert r.max_util == pytest.approx(0.2682, abs=2e-4) and r.risk == "safe"
    assert made["beam", "optimistic", "along"].max_deflection == pytest.approx(0.3572, abs=2e-4)
    assert made["beam", "pessimistic", "along"].max_deflection == pytest.approx(0.6495, abs=2e-4)
    assert made["beam", "optimistic", "along"].max_util == pytest.approx(0.1609, abs=2e-4)
    assert made["beam", "pessimistic", "along"].max_util == pytest.approx(0.4827, abs=2e-4)


def test_direction_and_notch(made):
    across = made["beam", "realistic", "across"]
    assert across.e == pytest.approx(1680) and across.allowable == pytest.approx(18.27)
    notched = made["notched", "realistic", "along"]
    assert notched.max_stress == pytest.approx(37.19, abs=0.02) and notched.max_util == pytest.approx(1.425, abs=2e-3) and notched.risk == "fail"


def test_models_without_a_solution(spark):
    beam = B.PRESETS["beam"]
    specs = {"none": {**beam, "supports": []}, "one roller": {**beam, "supports": [["roller", 0]]}, "thin": {**beam, "points": [[0, 0], [1, 0], [1, 5]]}}
    models = spark.createDataFrame([(k, json.dumps(v)) for k, v in specs.items()], "model string, spec string")
    rows = B.stations(B.matrix(models)).collect()
    assert len(rows) == 27 and all(r.error and r.x is None for r in rows)


def test_spread_load_matches_closed_form():
    model = {**B.PRESETS["beam"], "points_loads": [], "spread_loads": [[0, 140, 0.5]]}
    out = B.solve(model, 2400.0, 26.1)
    inertia = 6 * 20**3 / 12
    assert out["max_deflection"] == pytest.approx(5 * 0.5 * 140**4 / (384 * 2400 * inertia), rel=0.01)


def test_area_and_snap(spark):
    pts = [(float(x), float(y)) for x, y in B.PRESETS["notched"]["points"]]
    df = spark.createDataFrame([("n", pts)], "model string, points array<struct<x: double, y: double>>")
    r = B.polygon_area(df).first()
    assert (r.area, r.min_x, r.max_x, r.min_y, r.max_y) == (150 * 24 - 26 * 10, 0, 150, 0, 24)
    import pyspark.sql.functions as F

    got = spark.createDataFrame([(2.5,), (-2.5,), (7.49,)], "v double").select(B.snap(F.col("v"), 5.0)).collect()
    assert [float(x[0]) for x in got] == [5.0, 0.0, 5.0]
