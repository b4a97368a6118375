"""Candidates, offers and the run log of fetched pages, from one pass.

A page is scanned and parsed once. What it yields becomes rows of one kind of frame, told
apart by a tag, and the write splits them into folders by the tag: three results and the log
of how each came about, without reading a page twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import units as U
from ..functions.classify import page_space
from ..operators import prices as P
from ..scratch import folder
from . import html

#: One kind of row for all results; a tag's unused fields are null and take no room in its files.
FIELDS = {
    "tag": "string", "vendor": "string", "url": "string", "ord": "int", "link": "string", "hint": "string", "price": "string", "currency": "string", "variant": "string",
    "sku": "string", "availability": "string", "product_name": "string", "method": "string", "action": "string", "status": "string", "detail": "string",
}
#: What of a page the rows are made of.
READ = ("title", "heading", "metas", "links", "offers", "page_text")
OFFER = ("price", "currency", "variant", "sku", "availability", "product_name", "method")


@dataclass
class Harvest:
    candidates: DataFrame  # vendor, url (the page), ord, link, hint
    offers: DataFrame  # vendor, url, ord and the offer's columns
    log: DataFrame  # vendor, url, action, status, detail


def row(tag: str, **values: Column) -> Column:
    given = {"tag": F.lit(tag), "vendor": F.col("vendor"), "url": F.col("url"), **values}
    return F.struct(*[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in FIELDS.items()])


def tagged(pages: DataFrame, vendor: Column, visible_for: Column) -> DataFrame:
    """The rows of all tags of pages (url, html); `vendor` and `visible_for` are expressions over url."""
    parsed = html.parse_pages(pages, columns=READ).withColumn("vendor", vendor)
    parsed = parsed.withColumns({"found": html.offers_of(visible_for), "product": html.best_title(F.col("url"))})
    followed = F.filter("links", lambda a: X.is_followed(a["href"]))
    named = F.transform(followed, lambda a, i: F.struct(i.alias("ord"), X.normalize_price_url(a["url"]).alias("link"), page_space(a["text"]).alias("hint")))
    parsed = parsed.withColumn("leads", F.filter(named, lambda a: P.is_filament_url(a["link"], a["hint"])))
    candidates = F.transform("leads", lambda a: row("candidate", ord=a["ord"], link=a["link"], hint=a["hint"]))
    named = lambda o: {"product_name": F.coalesce(F.nullif(o["product_name"], F.lit("")), F.col("product"))}  # noqa: E731  an offer without a name is the page's
    offers = F.transform("found", lambda o, i: row("offer", ord=i, **{c: o[c] for c in OFFER} | named(o)))
    key = lambda o: F.struct(F.round(U.number_once(o["price"]), 4), *[page_space(o[c]) for c in ("currency", "variant", "sku")])
    parsed = parsed.withColumn("n", F.size(F.array_distinct(F.transform("found", key))))  # a column, so that it is worked out once
    n = F.col("n")
    links = row("log", action=F.lit("page_links"), status=F.lit("ok"), detail=F.concat(F.size("leads"), F.lit(" product links")))
    told = row("log", action=F.lit("fetch_product"), status=F.when(n > 0, "priced").otherwise("no_price"), detail=F.concat(n, F.lit(" offers; title="), F.substring("product", 1, 120)))
    return parsed.select(F.explode(F.concat(candidates, offers, F.array(links, told))).alias("r")).select("r.*")


def harvest(pages: DataFrame, vendor: Column, visible_for: Column, path: str | None = None) -> Harvest:
    """Write the tagged rows under `path` (the shared folder if none is given), and read each result from its own part."""
    spark = pages.sparkSession
    path = path or folder(spark)
    tagged(pages, vendor, visible_for).write.mode("overwrite").partitionBy("tag").parquet(path)
    every = spark.read.schema(", ".join(f"{n} {k}" for n, k in FIELDS.items())).parquet(path)
    part = lambda tag, *columns: every.where(F.col("tag") == tag).select("vendor", "url", *columns)  # noqa: E731  only this tag's folder is read
    return Harvest(part("candidate", "ord", "link", "hint"), part("offer", "ord", *OFFER), part("log", "action", "status", "detail"))


def statuses(log: DataFrame) -> DataFrame:
    """(action_status, n): how often each step ended in each way."""
    return log.groupBy(F.concat_ws(":", "action", "status").alias("action_status")).agg(F.count(F.lit(1)).alias("n"))


def price_rows(found: Harvest, rates: DataFrame, default_currency: Column) -> DataFrame:
    """Price rows of a harvest's offers: deduplicated a page, with masses, prices a kilogram and in dollars; `default_currency` is an expression over vendor."""
    kept = P.page_offers(found.offers, default_currency)
    path = F.translate(F.coalesce(F.try_url_decode(X.url_part(F.col("url"), "path")), F.lit("")), "-", " ")
    none = F.lit(None)
    mass = P.infer_mass([("variant", F.col("variant")), ("product", F.col("product_name")), ("url", path)], none.cast("double"), none.cast("string"), none.cast("string"))
    told = F.regexp_extract(F.coalesce("availability", F.lit("")), r"(\w+)$", 1)  # a name or the end of its address
    rows = kept.withColumn("mass", mass).select(
        "vendor", "url", "ord", F.col("product_name").alias("product"), "variant", "sku", "price", "currency", F.col("mass.kg").alias("mass_kg"), F.coalesce("mass.source", F.lit("")).alias("mass_source"),
        F.when(told != "", told).otherwise("InStock").alias("availability"), F.col("method").alias("price_source"),
    )
    return P.add_usd(P.dedupe_price_rows(rows, "ord"), rates)
