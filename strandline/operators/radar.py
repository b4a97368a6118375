"""A radar of series over a ring of axes: which axes stay, where points lie, and the segments between present neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import position

#: Axes that a ring has at most, and its radius.
MOST_AXES, RADIUS = 10, 122.0


def kept_axes(stat: DataFrame, span: DataFrame, keys: Sequence[str], most: int = MOST_AXES) -> DataFrame:
    """One row: `axes`, the array of (ord, key, lo, hi) of the keys whose range isn't a point and that some series has a value of, in the order of keys.

    stat: series, property_key, value. span: property_key, lo, hi, a row a property.
    """
    wanted = stat.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], "property_key string, ord int")
    wide = span.groupBy("property_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("hi > lo")
    met = stat.where("value IS NOT NULL").groupBy("property_key").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    rows = wanted.join(wide, "property_key").join(met, "property_key", "left_semi")
    every = F.array_sort(F.collect_list(F.struct("ord", F.col("property_key").alias("key"), "lo", "hi")))  # a row a key of the list
    return rows.agg(F.slice(every, 1, most).alias("axes"))


def ring_point(i: Column, n: Column, norm: Column, radius: float) -> Column:
    """A value's place on its spoke; spokes go clockwise from the top."""
    angle = i * (2 * math.pi) / n - math.pi / 2
    return F.struct((F.cos(angle) * norm * radius).alias("x"), (F.sin(angle) * norm * radius).alias("y"))


def rings(stat: DataFrame, axes: DataFrame, radius: float = RADIUS) -> DataFrame:
    """series, missing (axes without a value), complete, and points: an array in axis order of (key, norm, x, y), null where there is no value."""
    held = stat.where("value IS NOT NULL").groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("property_key", "value"))).alias("values"))  # a row a key
    ring = held.crossJoin(axes).withColumn("n", F.size("axes"))  # axes is one row

    def point(a: Column, i: Column) -> Column:
        value = F.try_element_at("values", a["key"])
        norm = position(value, a["lo"], a["hi"])
        at = ring_point(i, F.col("n"), norm, radius)
        return F.when(value.isNotNull(), F.struct(a["key"].alias("key"), norm.alias("norm"), at["x"].alias("x"), at["y"].alias("y")))

    made = ring.withColumn("points", F.transform("axes", point))
    missing = F.size(F.filter("points", lambda p: p.isNull()))
    return made.select("series", missing.alias("missing"), (missing == 0).alias("complete"), "points")


def segments(ring: DataFrame) -> DataFrame:
    """series, i, from_key, to_key and both ends: one row for each two neighbours of the ring that are both present.

    The neighbour after the last point is the first: the points are laid beside themselves turned by one.
    """
    n = F.size("points")
    turned = F.concat(F.slice("points", 2, F.greatest(n - 1, F.lit(0))), F.slice("points", 1, 1))
    pairs = F.transform("points", lambda p, i: F.struct(i.alias("i"), p.alias("a"), F.get(turned, i).alias("b")))
    both = ring.select("series", F.explode(F.filter(pairs, lambda s: s["a"].isNotNull() & s["b"].isNotNull())).alias("s"))
    return both.select(
        "series", "s.i", F.col("s.a.key").alias("from_key"), F.col("s.b.key").alias("to_key"),
        F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"),
    )


def subsets(stat: DataFrame, lists: dict[str, Sequence[str]]) -> DataFrame:
    """material_id, subset, ord, property_key, mean_value: each named list of keys in its own order, for every record that has some of them.

    A record's values are one map; a list's order is that of its array, so nothing is sorted.
    """
    held = stat.groupBy("material_id").agg(F.map_from_entries(F.collect_list(F.struct("property_key", "mean_value"))).alias("values"))  # a row a key
    some = {n: F.array(*[F.lit(k) for k in keys]) for n, keys in lists.items()}
    named = F.array(*[F.struct(F.lit(n).alias("subset"), keys.alias("keys")) for n, keys in some.items()])
    each = held.select("material_id", "values", F.explode(named).alias("s")).select("material_id", "values", "s.*")
    out = each.select("material_id", "values", "subset", F.posexplode("keys").alias("ord", "property_key")).withColumn("mean_value", F.try_element_at("values", F.col("property_key")))
    return out.where("mean_value IS NOT NULL").drop("values")
