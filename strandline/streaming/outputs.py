"""Price outputs that grow while candidates come, folded in a batch at a time, each exactly once.

A batch leaves two things under its number: its price rows, without those that an earlier
batch has already written, and a partial rollup by vendor. Both are overwritten whole if the
batch comes again, so a run that broke off anywhere and went on ends as one that didn't.
Partial rollups merge: counts add up, sets unite. What must be distinct over all batches (urls,
products) is kept as keyed rows, each by the batch that had it first, so that those counts add
up too. Reports read partials, whose number is vendors times batches, never the rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.prices import is_filament_row
from ..operators.stats import first_wins
from ..sources.sinks import files

#: What makes a price row the same row again.
KEY = ("vendor", "url", "sku", "variant", "price", "currency", "mass_kg")
#: Counted distinct by vendor over all batches: name of the count, column.
DISTINCT = {"priced_urls": "url", "priced_products": "product"}
COUNTS = ("price_rows", "with_mass", "with_price_per_kg", "with_usd", *DISTINCT)


def stored(spark: SparkSession, path: str, kind: str, before: int | None = None) -> DataFrame | None:
    """What batches (those under `before`, or all) have left of one kind; None if nothing."""
    fs, at = files(spark, path)
    root = f"{path.rstrip('/')}/{kind}"
    if not fs.exists(at(root)):
        return None
    numbers = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at(root)) if x.getPath().getName().startswith("batch=")]
    some = [n for n in numbers if (before is None or n < before) and fs.exists(at(f"{root}/batch={n}/_SUCCESS"))]
    return spark.read.option("basePath", root).parquet(*[f"{root}/batch={n}" for n in some]) if some else None


def fold(rows: DataFrame, number: int, path: str, order: str = "ord", filament_only: bool = True) -> None:
    """Add a batch of price rows (KEY, product, price_per_kg, price_usd, `order`) under its number."""
    spark = rows.sparkSession
    some = rows.where(is_filament_row(F.col("product"), F.col("variant"), F.col("url"))) if filament_only else rows
    once = first_wins(some, KEY, [F.col(order)])
    keyed = once.withColumn("__key", F.xxhash64(*KEY))
    earlier = stored(spark, path, "rows", number)
    if earlier is not None:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
        old = earlier.select(*KEY, F.xxhash64(*KEY).alias("__key"))
        keyed = keyed.alias("a").join(old.alias("b"), [F.col("a.__key") == F.col("b.__key"), *same], "left_anti")
    keyed.drop("__key").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    fresh = spark.read.parquet(f"{path}/rows/batch={number}")
    firsts = []
    for name, column in DISTINCT.items():
        met = fresh.select("vendor", F.lit(name).alias("what"), F.col(column).cast("string").alias("value")).distinct()
        known = stored(spark, path, "firsts", number)
        firsts.append(met if known is None else met.join(known.select("vendor", "what", "value"), ["vendor", "what", "value"], "left_anti"))
    firsts[0].unionByName(firsts[1]).write.mode("overwrite").parquet(f"{path}/firsts/batch={number}")
    new = spark.read.parquet(f"{path}/firsts/batch={number}").groupBy("vendor").agg(*[F.count_if(F.col("what") == n).alias(n) for n in DISTINCT])
    part = fresh.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("price_rows"), F.count("mass_kg").alias("with_mass"), F.count("price_per_kg").alias("with_price_per_kg"),
        F.count("price_usd").alias("with_usd"), F.collect_set("currency").alias("currencies"),
    )
    part.join(new, "vendor", "left").na.fill(0, list(DISTINCT)).write.mode("overwrite").parquet(f"{path}/partials/batch={number}")


def rollup(spark: SparkSession, path: str) -> DataFrame | None:
    """One row a vendor, from the partials of all batches."""
    parts = stored(spark, path, "partials")
    if parts is None:
        return None
    names = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("currencies")))), ",")  # a few names a batch
    return parts.groupBy("vendor").agg(*[F.sum(c).alias(c) for c in COUNTS], names.alias("currencies"))


def price_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """rows is a streaming frame of price rows; a batch that comes again replaces what it left before."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: fold(batch, number, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
