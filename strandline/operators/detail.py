"""Figures and listings of single records and of the whole set: counters, legends, property groups, sources, plot windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import category_rank
from .stats import first_wins, position, top_per_group, unknown

#: The order of categories; others come after them, by name.
CATEGORIES = ["Filament specs", "Print settings", "Mechanical", "Thermal", "Physical", "Electrical", "Safety / chemical", "Other"]
MOST_METHODS, MOST_CONTEXTS = 12, 4
MOST_ZOOM, ZOOM_STEP = 18.0, 1.2


def kpis(materials: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: records, percent with observations, bases and suppliers, and the property most records have (the earlier key wins ties)."""
    order = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("property_key"))
    per_key = obs.where(F.col("property_key").isin(*keys)).groupBy("property_key").agg(F.countDistinct("material_id").alias("n"))
    best = per_key.agg(F.max_by(F.struct("property_key", "n"), F.struct(F.col("n"), -order)).alias("b"))
    live = obs.select("material_id").distinct().withColumn("live", F.lit(True))
    seen = materials.join(live, "material_id", "left")
    counts = seen.agg(
        F.count(F.lit(1)).alias("materials"),
        F.count("live").alias("parsed"),
        F.countDistinct(F.when(F.col("live"), unknown(F.col("base_material")))).alias("bases"),
        F.countDistinct(F.nullif("supplier", F.lit(""))).alias("suppliers"),
    )
    share = F.when(F.col("materials") > 0, 100 * F.col("parsed") / F.col("materials")).otherwise(0.0)
    return counts.crossJoin(best).select(  # one row each
        "materials", share.alias("parsed_percent"), "bases", "suppliers",
        F.coalesce("b.property_key", F.lit("No data")).alias("best_property"), F.coalesce("b.n", F.lit(0)).alias("best_materials"),
    )


def legend(materials: DataFrame, obs: DataFrame, column: str = "base_material") -> DataFrame:
    """Groups of records with observations, the largest first; equal ones by name."""
    live = materials.join(obs.select("material_id"), "material_id", "left_semi")
    return live.groupBy(unknown(F.col(column)).alias("group_value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group_value")


def property_groups(obs: DataFrame, definitions: DataFrame, key: Sequence[str], order: Sequence[Column], scope: DataFrame | None = None, ranks: Sequence[str] = CATEGORIES) -> DataFrame:
    """A record's observations, equal ones once, in scope, with `section` and its `place` among the categories.

    The category is the observation's own, else its definition's, else Other. Scope and definitions have a row a property, and are broadcast.
    """
    once = first_wins(obs, key, order)
    if scope is not None:
        once = once.join(F.broadcast(scope.select("property_key")), "property_key", "left_semi")
    named = once.join(F.broadcast(definitions.select("property_key", F.col("category").alias("__known"))), "property_key", "left")
    section = F.coalesce(F.nullif("category", F.lit("")), F.nullif("__known", F.lit("")), F.lit("Other"))
    named = named.withColumn("section", section).drop("__known")
    return named.withColumn("place", category_rank(F.col("section"), list(ranks)).cast("long"))


def metric_panel(stat: DataFrame, span: DataFrame, keys: Sequence[str], ids: DataFrame) -> DataFrame:
    """A row for each record of ids and each of the keys, with its place in the range; without a number 0."""
    grid = ids.select("material_id", F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("metric_order", "property_key"))
    found = grid.join(stat.select("material_id", "property_key", "mean_value", "n"), ["material_id", "property_key"], "left")
    placed = found.join(span, "property_key", "left")
    score = F.coalesce(position(F.col("mean_value"), F.col("lo"), F.col("hi")), F.lit(0.0))
    return placed.select("material_id", "metric_order", "property_key", "mean_value", F.coalesce("n", F.lit(0)).alias("n"), score.alias("score"))


def listed(rows: DataFrame, by: Sequence[str], column: str, most: int) -> DataFrame:
    """The first `most` distinct values of each group, sorted and joined; ranked before they are gathered, so that a group stays small."""
    some = rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(*by, column).distinct()
    top = top_per_group(some, by, [F.col(column)], most)
    return top.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(column)), "; ").alias(column))


def sources_panel(obs: DataFrame, methods: str = "test_method", contexts: str = "source_context") -> DataFrame:
    """The methods and source passages of every record."""
    ids = obs.select("material_id").distinct()
    made = ids.join(listed(obs, ["material_id"], methods, MOST_METHODS), "material_id", "left")
    return made.join(listed(obs, ["material_id"], contexts, MOST_CONTEXTS), "material_id", "left")


def material_tip(product: Column, supplier: Column, base: Column, family: Column, n: Column, notes: Column) -> Column:
    """Four lines about a record."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        empty(product), F.lit("\n"), F.concat_ws(" / ", empty(supplier), empty(base), empty(family)), F.lit("\n"),
        F.coalesce(n, F.lit(0)).cast("string"), F.lit(" extracted observations\n"), empty(notes),
    )


def shown_range(lo: Column, hi: Column, center: Column, zoom: Column) -> Column:
    """The part of lo..hi that a plot shows, as a struct (lo, hi): centred where asked, but inside the range. A range without width is shown one wide, from its value up."""
    half = F.when(hi > lo, hi - lo).otherwise(1.0) / zoom / 2
    middle = F.greatest(lo + half, F.least(hi - half, F.coalesce(center, (lo + hi) / 2)))
    return F.struct((middle - half).alias("lo"), (middle + half).alias("hi"))


def zoomed(lo: Column, hi: Column, shown: Column, zoom: Column, at: Column, closer: Column) -> Column:
    """(zoom, center) after a step at the fraction `at` of what is shown: the value there keeps its place."""
    part = F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))
    value = shown["lo"] + part * (shown["hi"] - shown["lo"])
    then = F.least(F.greatest(F.when(closer, zoom * ZOOM_STEP).otherwise(zoom / ZOOM_STEP), F.lit(1.0)), F.lit(MOST_ZOOM))
    span = F.when(hi > lo, hi - lo).otherwise(1.0) / then
    middle = F.greatest(lo + span / 2, F.least(hi - span / 2, value - part * span + span / 2))
    return F.struct(then.alias("zoom"), middle.alias("center"))
