"""Offers from a shop's product documents (the .js address of a product page): one row a priced variant.

A document is parsed once into a variant value; its `variants` are exploded in a lateral join,
and each path is typed as it is read, so a field of the wrong kind is a null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.classify import page_space
from ..operators.prices import infer_mass

#: A whole price above this is in hundredths; prices outside the open range are dropped.
CENTS_ABOVE, LEAST, MOST = 200, 0, 10000


def typed(value: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), f"$.{path}", kind)


def said(text: str, value: str, path: str) -> Column:
    """A field as text if it says something: neither missing, false, zero nor empty; `text` is the column of `texts` that holds it."""
    tidy = page_space(F.col(text))
    words = F.schema_of_variant(typed(value, path, "variant")) == "STRING"
    return F.when((tidy != "") & (~tidy.isin("false", "0", "0.0") | F.coalesce(words, F.lit(False))), tidy)


def texts(df: DataFrame, value: str, paths: dict[str, str]) -> DataFrame:
    """Fields as text columns of their own, each read once, however often it is looked at."""
    return df.withColumns({name: F.coalesce(typed(value, path, "string"), F.lit("")) for name, path in paths.items()})


def lines(text: Column) -> Column:
    """A description's text, a line a block."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)<(?:br|/p|/li|/div|/tr|/h\d)[^>]*>", "\n"), r"<[^>]*>", " ")


def documents(fetched: DataFrame) -> DataFrame:
    """fetched (vendor, url, hint, source, content_type, body) with `doc`, null where the answer is no JSON."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    is_json = F.contains(kind, F.lit("json")) | F.contains(kind, F.lit("javascript"))
    return fetched.withColumn("endpoint", X.product_json_url(F.col("url"))).withColumn("doc", F.when(is_json & F.col("endpoint").isNotNull(), F.try_parse_json("body")))


def variants(docs: DataFrame) -> DataFrame:
    """A row an element of a document's list of variants: the document's columns, without `doc`, `at` and `v`."""
    spark = SparkSession.active()
    listed = docs.withColumn("list", F.try_variant_get(F.col("doc"), "$.variants", "variant")).drop("doc")
    each = listed.lateralJoin(spark.tvf.variant_explode(F.col("list").outer()).select(F.col("pos").alias("at"), F.col("key"), F.col("value").alias("v")))
    # an array's elements have no key, an object's have; asked of the list itself, a document would be parsed twice
    return each.where("key IS NULL").drop("list", "key")


def product_rows(fetched: DataFrame, currencies: dict[str, str]) -> DataFrame:
    """Price rows of product documents; `currencies` are the vendors' own."""
    docs = texts(documents(fetched), "doc", {"name": "title", "about": "description"})
    docs = docs.withColumns({"product": F.coalesce(said("name", "doc", "title"), page_space(F.coalesce("hint", F.lit("")))), "blocks": lines(F.col("about"))})
    meta = F.substring(page_space(F.regexp_extract("about", r'(?i)<meta[^>]*(?:name="description"|property="og:description")[^>]*content="([^"]*)"', 1)), 1, 500)
    path = F.translate(F.coalesce(F.try_url_decode(X.url_part(F.col("url"), "path")), F.lit("")), "-", " ")
    none = F.lit(None)
    mass = lambda probes, labelled: infer_mass(probes, none.cast("double"), none.cast("string"), labelled)
    # what a document says of all its variants is worked out before they are rows
    docs = docs.withColumn("own", mass([("product", F.col("product")), ("url", path), ("description", meta)], F.col("blocks")))
    docs = docs.select("vendor", X.normalize_price_url(F.col("url")).alias("url"), "source", "product", "own", "doc")
    # only an object has a price; an array, and exploded: a filter on the price would read it from the document time and again
    price = F.transform(F.array(typed("v", "price", "double")), lambda r: F.when(r > CENTS_ABOVE, r / 100).otherwise(r))
    each = variants(docs).select("*", F.explode(F.filter(price, lambda p: (p > LEAST) & (p < MOST))).alias("price"))
    fields = ("name", "public_title", "title", "sku", "available")
    each = texts(each, "v", {f"{c}_text": c for c in fields})
    name, public, title, sku, available = (said(f"{c}_text", "v", c) for c in fields)
    each = each.withColumns({"variant": F.coalesce(name, public, title, F.lit("")), "sku": F.coalesce(sku, F.lit("")), "available": available.isNotNull()})
    known = F.create_map(*[F.lit(x) for kv in currencies.items() for x in kv]) if currencies else F.create_map().cast("map<string, string>")
    each = each.withColumn("mass", F.coalesce(mass([("variant", F.col("variant"))], none.cast("string")), F.col("own")))
    return each.select(
        "vendor", "product", "variant", "sku", "url", F.col("at").alias("ord"), F.round("price", 4).alias("price"),
        F.coalesce(F.try_element_at(known, F.col("vendor")), F.lit("")).alias("currency"), F.col("mass.kg").alias("mass_kg"), F.coalesce("mass.source", F.lit("")).alias("mass_source"),
        F.round(F.col("price") / F.when(F.col("mass.kg") > 0, F.col("mass.kg")), 4).alias("price_per_kg"), F.when(F.col("available"), "InStock").otherwise("OutOfStock").alias("availability"),
        F.lit("shopify_product_js").alias("price_source"), F.col("source").alias("candidate_source"),
    )


def product_log(rows: DataFrame) -> DataFrame:
    """A log row for each product with priced variants."""
    n = rows.groupBy("vendor", "url").agg(F.count(F.lit(1)).alias("n"), F.min("product").alias("product"))
    return n.select("vendor", "url", F.lit("fetch_product_js").alias("action"), F.lit("priced").alias("status"), F.concat("n", F.lit(" variants; title="), F.substring("product", 1, 120)).alias("detail"))
