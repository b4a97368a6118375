"""Statistics of observations: coverage, per-record and per-group figures, ranges and scores.

An observation frame has material_id, property_key, value (nullable double), orientation
and an `ordinal` that orders rows totally; where first-wins matters it decides.
Exact quantiles count equal values first, then rank those of the buckets that hold the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Buckets an octave of values falls into, for exact quantiles.
BUCKETS = 1024


def bucket(value: Column, per_octave: int = BUCKETS) -> Column:
    """A whole number that never falls as value grows: what bounds the rows that are ranked together."""
    v = value.cast("double")
    return F.when(F.isnan(v), F.lit((1 << 62) - 1)).otherwise(F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * per_octave))


def counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, __n (how often) and __b (the value's bucket) of the values that are there: all figures of numbers come from here, by one shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", bucket(F.col(value)))


def figures(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, min_value, max_value and mean_value of each group of counted values."""
    return counts.groupBy(*by).agg(
        F.sum("__n").alias("n"), (F.min(value) + 0.0).alias("min_value"), (F.max(value) + 0.0).alias("max_value"),
        (F.sum(F.col(value).cast("double") * F.col("__n")) / F.sum("__n")).alias("mean_value"),
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles, linear between ranks, as columns named by `probs`."""
    return ranked_quantiles(counted(df, by, value), by, value, probs)


def ranked_quantiles(counts: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of counted values.

    Equal values are counted first, map-side too, and summed by buckets of the value: a few
    thousand rows a group at any size. Running sums over those tell in which buckets the
    wanted ranks lie; only their values are ranked, a bucket at a time, in sorts that spill.
    So no group passes through one task, however many of its values differ.
    """
    group = W.partitionBy(*by)
    sums = counts.groupBy(*by, "__b").agg(F.sum("__n").alias("__in"))
    sums = sums.withColumn("__before", F.sum("__in").over(group.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__in"))
    sums = sums.withColumn("__all", F.sum("__in").over(group))
    ranks = {n: (F.col("__all") - 1) * F.lit(p) for n, p in probs.items()}
    inside = lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in"))
    wanted = sums.where(F.greatest(F.lit(False), *[inside(f(at)) for at in ranks.values() for f in (F.floor, F.ceil)]))
    named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    some = counts.join(
        wanted.select(*named, F.col("__b").alias("__wb"), "__before", "__all"),
        [F.col("__b") == F.col("__wb"), *[F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]],
    )
    upto = F.sum("__n").over(W.partitionBy(*by, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = some.withColumn("__upto", F.col("__before") + upto)
    parts = []
    for name, at in ranks.items():
        parts += [
            F.min(F.when(F.col("__upto") > F.floor(at), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__part_{name}"),
        ]
    made = ranked.groupBy(*by).agg(*parts)
    between = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__part_{n}") + 0.0).alias(n) for n in probs
    ]
    return made.select(*by, *between)


def coverage(obs: DataFrame, properties: DataFrame) -> DataFrame:
    """One row a property, also for those never observed: materials, observations and figures of the numbers."""
    made = obs.groupBy("property_key").agg(F.countDistinct("material_id").alias("materials"), F.count(F.lit(1)).alias("observations"))
    counts = counted(obs, ["property_key"], "value")
    numbers = figures(counts, ["property_key"], "value").withColumnRenamed("n", "numeric_observations")
    middle = numbers.join(ranked_quantiles(counts, ["property_key"], "value", {"median_value": 0.5}), "property_key")
    zero = ["materials", "observations", "numeric_observations"]
    return properties.join(made.join(middle, "property_key", "left"), "property_key", "left").na.fill(0, zero)


def totals(materials: DataFrame, obs: DataFrame) -> DataFrame:
    """Corpus counters in one row."""
    counts = obs.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("value").alias("numeric_observations"),
        F.countDistinct("material_id").alias("materials_with_observations"),
    )
    return materials.agg(F.count(F.lit(1)).alias("materials")).crossJoin(counts)  # one row each


def group_counts(materials: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Records by each dimension in one pass; missing and empty values count as Unknown."""
    named = materials.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), unknown(F.col(d)).alias("group_value")) for d in dims])).alias("g")
    )
    return named.groupBy("g.dimension", "g.group_value").agg(F.count(F.lit(1)).alias("materials"))


def unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def material_stat(obs: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean, extremes and count of the numbers of each record and property."""
    some = obs.where(F.col("property_key").isin(*keys)) if keys else obs
    return (
        some.where("value IS NOT NULL")
        .groupBy("material_id", "property_key")
        .agg(
            F.avg("value").alias("mean_value"),
            (F.min("value") + 0.0).alias("min_value"),
            (F.max("value") + 0.0).alias("max_value"),
            F.count("value").alias("n"),
        )
    )


def wide_stat(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """material_stat of rows whose properties stand side by side in columns: a group a record, not one a record and property, then a row a property."""
    made = rows.groupBy("material_id").agg(
        *[f.alias(f"{k}__{i}") for k in keys for i, f in enumerate((F.avg(k), F.min(k) + 0.0, F.max(k) + 0.0, F.count(k)))]
    )
    names = ["mean_value", "min_value", "max_value", "n"]
    each = F.array(*[F.struct(F.lit(k).alias("property_key"), *[F.col(f"{k}__{i}").alias(n) for i, n in enumerate(names)]) for k in keys])
    return made.select("material_id", F.explode(each).alias("s")).select("material_id", "s.*").where("n > 0")


def box(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, quartiles (linear between ranks), extremes, mean, and where quartiles stand in the range."""
    counts = counted(obs, by, "value")
    made = figures(counts, by, "value")
    out = made.join(ranked_quantiles(counts, by, "value", {"q1": 0.25, "median_value": 0.5, "q3": 0.75}), list(by))
    at = {f"{c}_at": position(F.col(c), F.col("min_value"), F.col("max_value")) for c in ("q1", "median_value", "q3")}
    return out.select(*by, "n", "q1", "median_value", "q3", "min_value", "max_value", "mean_value").withColumns(at)


def position(value: Column, lo: Column, hi: Column) -> Column:
    """Where value stands between lo and hi, kept in 0..1; 0 where the range is a point or missing."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return F.when(hi > lo, inside).otherwise(F.lit(0.0))


def extreme_records(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The records with the largest and smallest value of each group; the first ordinal wins ties."""
    some = obs.where("value IS NOT NULL")
    top = F.struct((F.col("value") + 0.0).alias("v"), (-F.col("ordinal")).alias("o"))
    low = F.struct((F.col("value") + 0.0).alias("v"), F.col("ordinal").alias("o"))
    return some.groupBy(*by).agg(
        F.max_by("material_id", top).alias("max_material"),
        (F.max("value") + 0.0).alias("max_value"),
        F.min_by("material_id", low).alias("min_material"),
        (F.min("value") + 0.0).alias("min_value"),
    )


def ranges(obs: DataFrame) -> DataFrame:
    """The range of each property's numbers over the whole database."""
    return obs.where("value IS NOT NULL").groupBy("property_key").agg(
        (F.min("value") + 0.0).alias("lo"), (F.max("value") + 0.0).alias("hi")
    )


def normalised(stat: DataFrame, span: DataFrame) -> DataFrame:
    """Per-record means placed in the database range; span has a row a property, so it is small by nature of the key list, and is broadcast: rows aren't shuffled by a handful of keys."""
    return stat.join(F.broadcast(span), "property_key").withColumn("norm", position(F.col("mean_value"), F.col("lo"), F.col("hi")))


def pivoted(norm: DataFrame, keys: Sequence[str], value: str = "norm") -> DataFrame:
    """One row a record with a column a key; missing stays null."""
    return norm.groupBy("material_id").agg(*[F.max(F.when(F.col("property_key") == k, F.col(value))).alias(k) for k in keys])


#: What stands in for a missing score part, in the order strength, stiffness, toughness, heat.
FALLBACKS = (0.5, 0.5, 0.42, 0.45)


def fingerprint(wide: DataFrame, parts: Sequence[tuple[str, str]]) -> DataFrame:
    """Named scores from a pivoted frame: (name, key) pairs, with fallbacks for missing ones."""
    return wide.select("material_id", *[F.coalesce(F.col(k), F.lit(FALLBACKS[i])).alias(n) for i, (n, k) in enumerate(parts)])


#: Materials that print easily, and those that need much heat.
EASY = ("PLA", "PETG", "PVB")
HOT = ("PEEK", "PEI", "PEKK", "PPS", "PPSU", "PSU")


def printability(nozzle: Column, bed: Column, chamber: Column, drying: Column, base: Column) -> Column:
    """Ease of printing in 0.08..0.98 from the base material and the settings; missing settings cost nothing."""
    name = F.upper(F.coalesce(base, F.lit("")))
    chemistry = F.when(name.isin(*EASY), 0.08).when(name.isin(*HOT), -0.22).when(name.startswith("PA"), -0.14).otherwise(0.0)
    heat = F.lit(0.22) * F.when(nozzle.isNull(), 0.0).otherwise(position(nozzle, F.lit(180.0), F.lit(445.0)))
    plate = F.lit(0.12) * F.when(bed.isNull(), 0.0).otherwise(position(bed, F.lit(0.0), F.lit(140.0)))
    extra = F.when(chamber > 40, 0.12).otherwise(0.0) + F.when(drying > 65, 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.08), F.least(F.lit(0.98), F.lit(0.82) + chemistry - heat - plate - extra))


def radar(norm: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean normalised value of each group and axis as columns, and how many axes a group lacks."""
    joined = norm.join(groups, "material_id")
    axes = [F.avg(F.when(F.col("property_key") == k, F.col("norm"))).alias(k) for k in keys]
    wide = joined.groupBy("group_value").agg(*axes)
    return wide.withColumn("missing_axes", sum(F.col(k).isNull().cast("int") for k in keys).cast("long"))


def compare(stat: DataFrame, pins: Sequence[int], keys: Sequence[str], value: str = "mean_value") -> DataFrame:
    """Keys by pinned records; a pair without numbers says so."""
    from functools import reduce

    spark = stat.sparkSession
    grid = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "property_key string, key_order int")
    some = stat.where(F.col("material_id").isin(*pins) & F.col("property_key").isin(*keys))
    cells = some.groupBy("property_key").agg(
        *[F.max(F.when(F.col("material_id") == p, F.round(value, 4).cast("string"))).alias(f"pin_{i + 1}") for i, p in enumerate(pins)]
    )
    out = grid.join(cells, "property_key", "left").drop("key_order")
    return reduce(lambda d, i: d.withColumn(f"pin_{i + 1}", F.coalesce(f"pin_{i + 1}", F.lit("No data"))), range(len(pins)), out)


def material_map(stat: DataFrame, x: str, y: str, size: str, limit: int, order: Sequence[Column]) -> DataFrame:
    """Records with both coordinates, the first `limit` of them, with a bubble radius from a third key's place in its range."""
    wide = stat.groupBy("material_id").agg(
        *[F.max(F.when(F.col("property_key") == k, F.col("mean_value"))).alias(c) for k, c in ((x, "x"), (y, "y"), (size, "s"))]
    )
    span = stat.where(F.col("property_key") == size).agg(F.min("mean_value").alias("lo"), F.max("mean_value").alias("hi"))
    both = wide.where("x IS NOT NULL AND y IS NOT NULL").orderBy(*order).limit(limit).crossJoin(span)  # span is one row
    radius = 5 + 10 * F.coalesce(position(F.col("s"), F.col("lo"), F.col("hi")), F.lit(0.0))
    return both.select("material_id", "x", "y", radius.alias("radius"))


def best_covered(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key with most numbers; the earlier key of the list wins ties."""
    order = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("property_key"))
    counts = obs.where(F.col("property_key").isin(*keys)).groupBy("property_key").agg(F.count("value").alias("n"))
    return counts.orderBy(F.desc("n"), order).limit(1)


def first_wins(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order of ascending columns, nulls first.

    A limit of one a key is applied in each task before the shuffle (Spark's window group
    limit), so a key with very many rows sends one row a task, and only key and order are compared.
    """
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def top_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
