"""Offers to price rows: candidates, dedupe in stages, masses, currencies, rollups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import units as U
from ..scratch import spread, tasks, written
from .stats import first_wins, top_per_group

#: Words of a material, words that rule a product out, and those that do unless it is a filament.
KEYWORDS = (
    "filament", "pla", "petg", "abs", "asa", "tpu", "tpe", "nylon", "pa", "pc", "pp", "pva", "hips", "pctg", "cpe", "carbon", "cf", "gf",
    "silk", "matte", "wood",
)
EXCLUDED = (
    "resin", "nozzle", "hotend", "dryer", "dry box", "storage bag", "vacuum storage", "adapter", "replacement", "accessory", "scanner",
    "laser", "wash", "cure",
)
UNLESS_FILAMENT = ("printer",)
PRODUCT_PATHS = ("/products/", "/product/", "/store/l/", "/materials/")
#: Sources of candidates that came with a sidecar.
SIDECARS = ("html_material_specs", "html_sidecar")
MAX_OFFERS = 60
#: Slices in which a vendor's candidates are ranked first.
SLICES = 64
#: Offers a task sorts, about: what bounds its memory.
TASK_OFFERS = 500_000


def any_of(hay: Column, words: Sequence[str]) -> Column:
    return F.coalesce(reduce(or_, [F.contains(hay, F.lit(w)) for w in words]), F.lit(False))  # ends at the first that is there


def hay_of(*parts: Column) -> Column:
    return F.translate(F.lower(X.squeeze(F.concat_ws(" ", *parts))), "-", " ")


def is_filament_url(url: Column, label: Column) -> Column:
    """A product page of a material: no excluded word, a material word, a product's path."""
    told = lambda path: F.struct(path.alias("path"), hay_of(path, F.coalesce(label, F.lit(""))).alias("hay"))

    def judged(t: Column) -> Column:
        barred = any_of(t["hay"], EXCLUDED) | (any_of(t["hay"], UNLESS_FILAMENT) & ~F.contains(t["hay"], F.lit("filament")))
        return ~barred & any_of(t["hay"], KEYWORDS) & any_of(t["path"], PRODUCT_PATHS)

    return U.bound(U.bound(F.lower(F.try_url_decode(X.url_part(url, "path"))), told), judged)


def is_filament_row(product: Column, variant: Column, url: Column) -> Column:
    return U.bound(hay_of(product, variant, url), lambda hay: ~any_of(hay, EXCLUDED) & ~hay.isin("materials ultimaker") & any_of(hay, KEYWORDS))


def dedupe_candidates(rows: DataFrame, key: Sequence[str], hint: str, order: str) -> DataFrame:
    """One row a key: the first with a hint; without any hint the last."""
    hinted = F.coalesce(F.col(hint) != "", F.lit(False))
    place = F.when(hinted, F.col(order)).otherwise(-F.col(order))
    return first_wins(rows, key, [F.when(hinted, 0).otherwise(1), place])


def capped_candidates(rows: DataFrame, limits: DataFrame, default: int = 60) -> DataFrame:
    """Per vendor the first candidates, sidecar ones first, then by url; limits has a row a vendor."""
    order = [F.when(F.col("source").isin(*SIDECARS), 0).otherwise(1), F.col("url")]
    named = rows.join(limits.select("vendor", "product_limit"), "vendor", "left").withColumn("__most", F.coalesce("product_limit", F.lit(default)))
    # first within slices of a vendor, so that a vendor with most of the urls is cut down by many tasks
    named = named.withColumn("__slice", F.pmod(F.xxhash64("url"), F.lit(SLICES)))
    for by in (["vendor", "__slice"], ["vendor"]):
        named = named.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= F.col("__most"))
    return named.drop("__rn", "__most", "__slice", "product_limit")


def discover(parts: Sequence[DataFrame], limits: DataFrame, default: int = 60) -> DataFrame:
    """Candidates (vendor, url, hint, source, place) of sidecar, sitemaps, seeds and seed pages, in that order: once each, then capped.

    A seed counts only if it looks like a product's address; the caller filters it by is_filament_url.
    """
    rows = None
    for k, part in enumerate(parts):
        named = part.select("vendor", X.normalize_price_url(F.col("url")).alias("url"), "hint", "source", F.struct(F.lit(k).alias("part"), F.col("place").cast("long").alias("place")).alias("found"))
        rows = named if rows is None else rows.unionByName(named)
    hinted = F.coalesce("hint", F.lit("")) != ""
    late = [F.when(hinted, F.col("found")[c]).otherwise(-F.col("found")[c]) for c in ("part", "place")]
    kept = first_wins(rows, ["vendor", "url"], [F.when(hinted, 0).otherwise(1), *late])
    return capped_candidates(kept.drop("found"), limits, default)


def dedupe_offers(rows: DataFrame, price: str, exact: Sequence[str], identity: Column, score: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Three stages: equal offers once; the best-scored of an identity; no nameless offer beside a named one of that price.

    `by` holds what separates pages; within them `exact` are the columns of equal offers, and a price with a
    currency is shared by `identity`. Offers of a page are few, so windows tell which prices have a named offer;
    where no pages separate them, a price may have very many, and the prices are joined.
    """
    pair = [*by, price, "currency"]
    once = first_wins(rows, [*by, *exact], [F.col(order)])
    best = first_wins(once.withColumn("__id", identity).withColumn("__score", score), [*pair, "__id"], [-F.col("__score"), F.col(order)]).drop("__id", "__score")
    if by:
        named = F.coalesce(F.max(F.col("variant") != "").over(W.partitionBy(*pair)), F.lit(False))
        return best.withColumn("__named", named).where((F.col("variant") != "") | ((F.col("variant") == "") & ~F.col("__named"))).drop("__named")
    best = written(best)  # read three times
    # the prices that some named offer has are one row each: nameless offers are checked against them
    taken = best.where(F.col("variant") != "").select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(pair)]).distinct()
    beside = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(pair)]
    return best.where(F.col("variant") != "").unionByName(best.where(F.col("variant") == "").join(taken, beside, "left_anti"))


def page_offers(offers: DataFrame, default_currency: Column) -> DataFrame:
    """Offers (url, ord, price, currency, variant, sku, method) of pages, deduplicated and capped to MAX_OFFERS a page.

    One shuffle brings a page's offers together; all steps go on from there.
    """
    clean = spread(offers, "url", n=tasks(offers, TASK_OFFERS)).withColumns(
        {
            "price": F.round(U.number_or_none(F.col("price")), 4),
            "currency": F.coalesce(F.nullif(X.squeeze(F.col("currency")), F.lit("")), default_currency, F.lit("")),
            "variant": X.squeeze(F.col("variant")),
            "sku": X.squeeze(F.col("sku")),
        }
    ).where("price IS NOT NULL")
    score = F.length("variant") + F.when(F.col("method") == "shopify_variant_json", 100).otherwise(0)
    identity = F.coalesce(F.nullif("sku", F.lit("")), F.col("variant"))
    kept = dedupe_offers(clean, "price", ["price", "currency", "variant", "sku"], identity, score, "ord", by=["url"])
    return top_per_group(kept, ["url"], [F.col("ord")], MAX_OFFERS).drop("rank")


def infer_mass(probes: Sequence[tuple[str, Column]], sidecar_kg: Column, sidecar_source: Column, labelled: Column) -> Column:
    """(kg, source): the largest mass of the first probe that has one, then the sidecar's, then labelled lines."""
    told = lambda name: lambda m: F.when(m.isNotNull(), F.struct(F.round(m["kg"], 6).alias("kg"), F.concat(F.lit(name + ":"), m["raw"]).alias("source")))  # noqa: E731  of what one search has found
    found = [U.largest_mass(text, told(name)) for name, text in probes]
    side = F.when(sidecar_kg.isNotNull(), F.struct(sidecar_kg.alias("kg"), sidecar_source.alias("source")))
    return F.coalesce(*found, side, labelled_mass(labelled, told("labeled_page_text")))


def labelled_mass(text: Column, finish=lambda m: m) -> Column:
    """The largest mass of lines about a weight that isn't the empty spool's or the parcel's."""
    lines = F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"\R"),
        lambda x: F.contains(x, F.lit("weight")) & ~x.rlike("empty spool|gross|package|shipping|carton"),
    )
    return F.when(text.rlike("(?i)weight"), U.largest(F.flatten(F.transform(lines, U.mass_candidates)), finish))


def availability(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(True)), "InStock").otherwise("OutOfStock")


def add_usd(rows: DataFrame, rates: DataFrame, places: int | None = 4) -> DataFrame:
    """Adds price_per_kg, rate, price_usd and price_per_kg_usd; unknown currencies give nulls. rates has a row a currency, and is broadcast."""
    to = (lambda c: c) if places is None else (lambda c: F.round(c, places))
    per_kg = to(F.col("price") / F.when(F.col("mass_kg") > 0, F.col("mass_kg")))
    out = rows.join(F.broadcast(rates.select("currency", "rate")), "currency", "left").withColumn("price_per_kg", per_kg)
    return out.withColumns({"price_usd": to(F.col("price") * F.col("rate")), "price_per_kg_usd": to(F.col("price_per_kg") * F.col("rate"))})


def dedupe_price_rows(rows: DataFrame, order: str) -> DataFrame:
    """Filament rows, once per page, article, price and mass."""
    some = rows.where(is_filament_row(F.col("product"), F.col("variant"), F.col("url")))
    return first_wins(some, ["vendor", "url", "sku", "variant", "price", "currency", "mass_kg"], [F.col(order)])


def vendor_rollup(rows: DataFrame) -> DataFrame:
    """Counts by vendor, and its currencies in order."""
    return rows.groupBy("vendor").agg(
        F.countDistinct("url").alias("candidate_urls"),
        F.count(F.lit(1)).alias("price_rows"),
        F.countDistinct("product").alias("products"),
        F.count("mass_kg").alias("with_mass"),
        F.count("price_per_kg").alias("with_price_per_kg"),
        F.count("price_usd").alias("with_usd"),
        F.array_join(F.sort_array(F.collect_set("currency")), ",").alias("currencies"),
    )
