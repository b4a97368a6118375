"""Beam screening: sections of a drawn part, a scenario matrix solved group by group, and what is read off.

Sections and figures are column expressions; the linear solve of one model and scenario,
at most 262 unknowns, is a numpy kernel inside applyInPandas.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stiffness and strength in MPa, scenario and direction factors.
MATERIALS = {"PLA": (3200.0, 58.0), "PETG": (2100.0, 50.0), "ABS": (1900.0, 38.0), "Custom": (2500.0, 45.0)}
SCENARIOS = {"optimistic": (1.0, 0.75), "realistic": (0.75, 0.45), "pessimistic": (0.55, 0.25)}
DIRECTIONS = {"along": (1.0, 1.0), "mixed": (0.85, 0.8), "across": (0.7, 0.7)}
#: Example parts.
PRESETS = {
    "beam": {"thickness": 6, "points": [[0, 0], [140, 0], [140, 20], [0, 20]], "supports": [["pinned", 0], ["roller", 140]], "points_loads": [[70, 80]]},
    "notched": {"thickness": 6, "points": [[0, 0], [150, 0], [150, 24], [92, 24], [92, 14], [66, 14], [66, 24], [0, 24]], "supports": [["pinned", 0], ["roller", 150]], "points_loads": [[75, 90]]},
    "tapered": {"thickness": 5, "points": [[0, 0], [150, 5], [150, 24], [0, 34]], "supports": [["fixed", 0]], "points_loads": [[145, 55]]},
    "bracket": {"thickness": 6, "points": [[0, 0], [95, 0], [95, 18], [36, 18], [36, 58], [0, 58]], "supports": [["fixed", 0]], "points_loads": [[88, 70]]},
}


def sections(points: np.ndarray, at: np.ndarray, axis: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(filled length, centre) of the polygon's cuts across `axis` at each place; edges are half-open."""
    u, v = points[:, axis], points[:, 1 - axis]
    u2, v2 = np.roll(u, -1), np.roll(v, -1)
    some = np.abs(u2 - u) >= 1e-9
    u, v, u2, v2 = u[some], v[some], u2[some], v2[some]
    cut = (at[:, None] >= np.minimum(u, u2)) & (at[:, None] < np.maximum(u, u2))
    hit = np.sort(np.where(cut, v + (at[:, None] - u) / (u2 - u) * (v2 - v), np.inf), axis=1)
    hit = hit[:, : hit.shape[1] // 2 * 2]
    lo, hi = hit[:, 0::2], hit[:, 1::2]
    full = np.isfinite(hi)
    size = np.where(full, np.maximum(0, np.where(full, hi, 0) - np.where(full, lo, 0)), 0)
    total = size.sum(axis=1)
    middle = (np.where(full, (np.where(full, lo, 0) + np.where(full, hi, 0)) / 2, 0) * size).sum(axis=1)
    return total, np.where(total > 0, middle / np.where(total > 0, total, 1), 0.0)


def solve(model: dict, e: float, allowable: float) -> dict:
    """Stations and extremes of one model, or why there are none."""
    points = np.array(model["points"], float)
    low, high = points[:, 0].min(), points[:, 0].max()
    span = high - low
    if not np.isfinite(span) or span <= 1:
        return {"error": "Draw a shape with nonzero span."}
    if not model["supports"]:
        return {"error": "Add at least one support."}
    n = int(max(36, min(130, np.floor(span / 1.5 + 0.5))))
    x = low + span * np.arange(n + 1) / n
    inside = lambda p: np.clip(p, low + 1e-5, high - 1e-5)
    thick = float(model["thickness"])
    height = np.maximum(0.2, sections(points, inside(x))[0])
    inertia = thick * height**3 / 12
    e, allowable = max(1.0, e), max(0.1, allowable)
    le = np.diff(x)
    ei = e * np.maximum(0.001, (inertia[:-1] + inertia[1:]) / 2)
    size = 2 * (n + 1)
    k, f = np.zeros((size, size)), np.zeros(size)
    for i in range(n):
        s, h = ei[i], le[i]
        bend = np.array([[12, 6 * h, -12, 6 * h], [6 * h, 4 * h * h, -6 * h, 2 * h * h], [-12, -6 * h, 12, -6 * h], [6 * h, 2 * h * h, -6 * h, 4 * h * h]])
        k[2 * i : 2 * i + 4, 2 * i : 2 * i + 4] += bend * (s / h**3)
    nearest = lambda p: int(np.argmin(np.abs(x - p)))  # noqa: E731  the first of equally near ones
    for at, force in model.get("points_loads", []):
        f[2 * nearest(at)] += float(np.clip(force, -100000, 100000))
    for a, b, w in model.get("spread_loads", []):
        over = np.maximum(0, np.minimum(x[1:], max(a, b)) - np.maximum(x[:-1], min(a, b)))
        q = float(np.clip(w, -10000, 10000)) * over / le
        np.add.at(f, 2 * np.arange(n), q * le / 2)
        np.add.at(f, 2 * np.arange(n) + 1, q * le**2 / 12)
        np.add.at(f, 2 * np.arange(n) + 2, q * le / 2)
        np.add.at(f, 2 * np.arange(n) + 3, -q * le**2 / 12)
    held = {2 * nearest(at) for _, at in model["supports"]} | {2 * nearest(at) + 1 for kind, at in model["supports"] if kind == "fixed"}
    if len(held) < 2 and not any(d % 2 for d in held):
        return {"error": "Model is under-constrained. Add another vertical support or a fixed support."}
    free = np.array([d for d in range(size) if d not in held])
    u = np.zeros(size)
    try:
        u[free] = np.linalg.solve(k[np.ix_(free, free)], f[free])
    except np.linalg.LinAlgError:
        return {"error": "Solver could not resolve the model. Check supports and geometry."}
    # three stations an element
    r = np.tile([0.0, 0.5, 1.0], n)
    el = np.repeat(np.arange(n), 3)
    h, d = le[el], np.stack([u[2 * el], u[2 * el + 1], u[2 * el + 2], u[2 * el + 3]])
    at = x[el] + h * r
    total, centre = sections(points, inside(at))
    tall = np.maximum(0.2, total)
    second = thick * tall**3 / 12
    curve = (12 * r - 6) / h**2 * d[0] + (6 * r - 4) / h * d[1] + (6 - 12 * r) / h**2 * d[2] + (6 * r - 2) / h * d[3]
    third = 12 / h**3 * (d[0] - d[2]) + 6 / h**2 * (d[1] + d[3])
    moment, shear = e * second * curve, e * second * third
    before, after = height[np.maximum(el - 1, 0)], height[np.minimum(el + 1, n)]
    wide = np.maximum(1.0, np.abs(x[np.minimum(el + 1, n)] - x[np.maximum(el - 1, 0)]))
    jump = np.abs(after - height[el]) > 0.22 * height[el]
    kt = 1 + np.minimum(1.4, 3.2 * np.abs(after - before) / wide + 0.35 * jump)
    stress = kt * np.maximum(np.abs(moment) * tall / 2 / np.maximum(0.001, second), 1.5 * np.abs(shear) / np.maximum(0.001, thick * tall))
    sag = (1 - 3 * r**2 + 2 * r**3) * d[0] + h * (r - 2 * r**2 + r**3) * d[1] + (3 * r**2 - 2 * r**3) * d[2] + h * (r**3 - r**2) * d[3]
    stations = pd.DataFrame({"x": at, "deflection": sag, "moment": moment, "shear": shear, "stress": stress, "util": stress / allowable, "height": tall, "y_center": centre, "kt": kt})
    return {"error": None, "e": e, "allowable": allowable, "max_deflection": float(np.abs(u[0::2]).max()), "stations": stations}


def matrix(models: DataFrame, material: str = "ABS", e: float | None = None, strength: float | None = None) -> DataFrame:
    """Models (model, spec JSON) by scenario and direction, with E and the allowable stress."""
    spark = models.sparkSession
    base = (e, strength) if e is not None else MATERIALS[material]
    rows = [(s, d, base[0] * fe * de, base[1] * fa * da) for s, (fe, fa) in SCENARIOS.items() for d, (de, da) in DIRECTIONS.items()]
    return models.crossJoin(F.broadcast(spark.createDataFrame(rows, "scenario string, direction string, e double, allowable double")))  # nine rows


STATION = "model string, scenario string, direction string, station int, error string, e double, allowable double, max_deflection double, x double, deflection double, moment double, shear double, stress double, util double, height double, y_center double, kt double"


def stations(cases: DataFrame) -> DataFrame:
    """One row a station of every case; a case that can't be solved gives one row with its error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        out = solve(json.loads(row.spec), float(row.e), float(row.allowable))
        made = out.pop("stations", pd.DataFrame([{}]))
        for c, v in {"model": row.model, "scenario": row.scenario, "direction": row.direction, **out}.items():
            made[c] = v
        made["station"] = range(len(made))
        return made.reindex(columns=[f.split()[0] for f in STATION.split(", ")]).astype({"station": "int32"})

    return cases.groupBy("model", "scenario", "direction").applyInPandas(run, STATION)


def summary(made: DataFrame) -> DataFrame:
    """Extremes of each case and its risk level."""
    top = lambda c: F.max(F.abs(F.col(c)))
    out = made.groupBy("model", "scenario", "direction").agg(
        F.max("error").alias("error"), F.max("e").alias("e"), F.max("allowable").alias("allowable"), F.max("max_deflection").alias("max_deflection"),
        top("stress").alias("max_stress"), top("moment").alias("max_moment"), top("shear").alias("max_shear"), F.max("util").alias("max_util"),
    )
    return out.withColumn("risk", risk(F.col("max_util")))


def risk(util: Column) -> Column:
    return F.when(util >= 1, "fail").when(util >= 0.65, "watch").when(util.isNotNull(), "safe")


def preset_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in PRESETS.items()], "model string, spec string")


#: Width of the bins along x in which sections, nodes and loads of one model meet, in the model's unit of length.
BIN = 4.0


def bin_of(x: Column, width: float) -> Column:
    return F.floor(x / width)


def in_bins(df: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    """Each row once for every bin that lo..hi touches, as __bin; __first is the first of them."""
    first, last = bin_of(F.least(lo, hi), width), bin_of(F.greatest(lo, hi), width)
    return df.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))


def cross_sections(edges: DataFrame, cuts: DataFrame, width: float = BIN) -> DataFrame:
    """Filled length and centre of polygons' vertical cuts: edges (model, x1, y1, x2, y2), cuts (model, x).

    A half-open theta join inside bins of x, so that a model with very many edges and cuts is
    spread over tasks; then neighbouring crossings pair up.
    """
    e = in_bins(edges.where("abs(x2 - x1) >= 1e-9"), F.col("x1"), F.col("x2"), width).drop("__first")
    hit = cuts.withColumn("__bin", bin_of(F.col("x"), width)).join(e, ["model", "__bin"]).where("x >= least(x1, x2) AND x < greatest(x1, x2)")
    hit = hit.withColumn("y", F.expr("y1 + (x - x1) / (x2 - x1) * (y2 - y1)"))
    ys = hit.groupBy("model", "x").agg(F.sort_array(F.collect_list("y")).alias("ys"))  # a polygon's crossings of one line
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("ys") / 2).cast("int") - 1), lambda i: F.struct(F.get("ys", i * 2).alias("a"), F.get("ys", i * 2 + 1).alias("b")))
    spans = F.when(F.size("ys") >= 2, spans).otherwise(F.array().cast("array<struct<a: double, b: double>>"))
    total = F.aggregate("s", F.lit(0.0), lambda t, i: t + (i["b"] - i["a"]))
    weighted = F.aggregate("s", F.lit(0.0), lambda t, i: t + (i["a"] + i["b"]) / 2 * (i["b"] - i["a"]))
    return ys.select("model", "x", spans.alias("s")).select("model", "x", total.alias("total"), F.when(total > 0, weighted / total).alias("center"))


def nearest(points: DataFrame, nodes: DataFrame, width: float = BIN) -> DataFrame:
    """For every point (model, id, x) the nearest node (model, idx, node_x); the lowest index wins ties.

    The nearest node is the last one at or before the point or the first one after it. Inside
    a bin of x both are found in order of x; across bins it takes each bin's first and last
    node alone, which is a row a bin.
    """
    at = F.struct(F.col("node_x"), F.col("idx"))
    low, high = F.struct("node_x", "idx"), F.struct("node_x", (-F.col("idx")).alias("turned"), "idx")
    marks = nodes.groupBy("model", "node_x").agg(F.min("idx").alias("idx")).withColumn("__bin", bin_of(F.col("node_x"), width))
    ends = marks.groupBy("model", "__bin").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    spots = points.withColumn("__bin", bin_of(F.col("x"), width))
    bins = spots.select("model", "__bin").distinct().join(ends, ["model", "__bin"], "full")
    line = W.partitionBy("model").orderBy("__bin")  # a row a bin
    back = F.last("hi", True).over(line.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.first("lo", True).over(line.rowsBetween(1, W.unboundedFollowing))
    bins = bins.select("model", "__bin", F.struct(back["node_x"].alias("node_x"), back["idx"].alias("idx")).alias("back"), ahead.alias("ahead"))
    both = spots.select("model", "__bin", F.col("x").alias("__x"), "id", F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("node_x"), F.lit(None).cast("long").alias("idx")).unionByName(
        marks.select("model", "__bin", F.col("node_x").alias("__x"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(0).alias("__kind"), "node_x", F.col("idx").cast("long").alias("idx"))
    )
    inside = W.partitionBy("model", "__bin").orderBy("__x", "__kind")
    node = F.when(F.col("__kind") == 0, at)
    both = both.withColumns({"before": F.last(node, True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "after": F.first(node, True).over(inside.rowsBetween(0, W.unboundedFollowing))})
    met = both.where("__kind = 1").select("model", "__bin", "id", F.col("__x").alias("x"), "before", "after").join(bins, ["model", "__bin"])
    away = lambda n: F.when(n["node_x"].isNotNull(), F.struct(F.abs(n["node_x"] - F.col("x")).alias("d"), n["idx"].alias("idx")))
    best = F.array_min(F.array_compact(F.array(*[away(F.col(c)) for c in ("before", "after", "back", "ahead")])))
    return met.select("model", "id", "x", best["idx"].alias("idx"), best["d"].alias("distance")).where("idx IS NOT NULL")


def overlaps(elements: DataFrame, loads: DataFrame, width: float = BIN) -> DataFrame:
    """Length that spread loads (model, id, x1, x2) share with elements (model, el, a, b); they meet in the first bin of x they share."""
    lo, hi = F.greatest("a", F.least("x1", "x2")), F.least("b", F.greatest("x1", "x2"))
    e = in_bins(elements, F.col("a"), F.col("b"), width).withColumnRenamed("__first", "__from")
    both = e.join(in_bins(loads, F.col("x1"), F.col("x2"), width), ["model", "__bin"]).where(F.col("__bin") == F.greatest("__from", "__first"))
    return both.withColumn("overlap", hi - lo).where("overlap > 0").select("model", "id", "el", "overlap")


def polygon_area(vertices: DataFrame) -> DataFrame:
    """Signed area and bounds of polygons given as (model, points array<struct<x, y>>)."""
    turned = F.transform("points", lambda p, i: p["x"] * F.get("points", (i + 1) % F.size("points"))["y"] - F.get("points", (i + 1) % F.size("points"))["x"] * p["y"])
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    return vertices.select(
        "model", (F.aggregate(turned, F.lit(0.0), lambda t, v: t + v) / 2).alias("area"),
        F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"),
    )


def snap(value: Column, step: float) -> Column:
    """To the grid, halves upward."""
    return F.floor(value / step + 0.5) * step


def turned(points: Column, area: Column) -> Column:
    """Vertices against the clock; fewer than three stay as they are."""
    return F.when((F.size(points) >= 3) & (area < 0), F.reverse(points)).otherwise(points)


def padded(lo: Column, hi: Column, least: float, pad: float, zoom: Column) -> Column:
    """The view around lo..hi, `least` wide at least, as a struct (lo, hi)."""
    half = (F.greatest(hi - lo, F.lit(float(least))) + 2 * pad) / zoom / 2
    return F.struct(((lo + hi) / 2 - half).alias("lo"), ((lo + hi) / 2 + half).alias("hi"))


def fitted(loads: DataFrame, bounds: DataFrame, grid: float | None = None) -> DataFrame:
    """Supports and loads (model, id, x1, x2; a point has no x2) moved inside the part's bounds.

    With a grid, as when one is added: places snap to it, and a spread load shorter than it is refused.
    """
    place = lambda c: snap(F.col(c), grid) if grid else F.col(c)
    inside = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(place(c), F.col("min_x")), F.col("max_x")))
    out = loads.join(bounds.select("model", "min_x", "max_x"), "model")
    out = out.withColumns({"x1": inside("x1"), "x2": inside("x2")}).drop("min_x", "max_x")
    return out.where(F.col("x2").isNull() | (F.abs(F.col("x1") - F.col("x2")) >= grid)) if grid else out
