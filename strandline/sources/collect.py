"""Which pages and files of a vendor's site to take. Fetching itself stays outside."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.classify import page_space
from ..functions.units import bound
from ..operators.prices import KEYWORDS, any_of

#: Words that rule pages out, with and without exception, and marks of documents.
NEVER = (
    "dryer", "dry box", "resin", "nozzle", "hotend", "build plate", "heater", "accessor", "adapter", "replacement", "wash", "cure", "scanner",
    "laser", "vacuum storage", "storage bag",
)
UNLESS_FILAMENT = ("combo", "centauri", "kobra", "neptune", "mars", "saturn", "jupiter", "mercury", "photon")
DATASHEET = ("tds", "technical data sheet", "technical datasheet")
NO_DATASHEET = (
    "sds", "msds", "safety data", "guide", "manual", "rohs", "reach", "certificate", "certification", "declaration", "catalog", "brochure",
)
#: Pages a vendor, and the default; statuses of vendors that still lack sources are given by the caller.
LIMITS = {"Anycubic": 35, "ColorFabb": 30, "Creality": 40, "Elegoo": 35, "Hatchbox": 30, "MatterHackers": 30, "SUNLU": 30}
DEFAULT_LIMIT = 25


def is_product_page(vendor: Column, url: Column, label: Column) -> Column:
    at = F.lower(F.try_url_decode(X.url_part(url, "path")))
    told = lambda path: F.struct(path.alias("path"), F.translate(F.lower(page_space(F.concat_ws(" ", path, label))), "-", " ").alias("hay"))

    def judged(t: Column) -> Column:
        path, hay = t["path"], t["hay"]
        barred = any_of(hay, NEVER) | (any_of(hay, UNLESS_FILAMENT) & ~F.contains(hay, F.lit("filament")))
        named = any_of(hay, KEYWORDS)
        fabb = (
            ~F.trim(path, F.lit("/")).isin("", "catalogue", "filaments", "materials") & ~path.startswith("/filaments/effects")
            & ~(path.startswith("/filaments/") & ~path.startswith("/filaments/materials/")) & ~F.contains(path, F.lit("/blog"))
            & (path.startswith("/filaments/materials/") | named)
        )
        shop = named & (F.contains(path, F.lit("/products/")) | ((vendor == "MatterHackers") & F.contains(path, F.lit("/store/l/"))))
        return ~barred & F.when(vendor == "ColorFabb", fabb).otherwise(shop)

    return bound(bound(at, told), judged)


def is_datasheet_link(label: Column, url: Column) -> Column:
    text = F.translate(F.lower(page_space(F.concat_ws(" ", label, F.try_url_decode(url)))), "_-", "  ")
    named = lambda hay: ~any_of(hay, NO_DATASHEET) & (any_of(hay, DATASHEET) | F.contains(hay, F.lit("filename=tds")))
    return X.is_pdf(url) & bound(text, named)


def datasheet_label(title: Column, link: Column, url: Column) -> Column:
    """Title, link text and file name, each once, marked as a datasheet."""
    name = F.translate(F.regexp_replace(F.element_at(F.split(F.try_url_decode(X.url_part(url, "path")), "/"), -1), r"\.[^.]*$", ""), "_-", "  ")
    parts = F.filter(F.array_distinct(F.transform(F.array(title, link, name), page_space)), lambda x: x != "")
    text = page_space(F.regexp_replace(F.array_join(parts, " "), r"(?i)\b(download|view|open)\b", ""))
    return F.when(text.rlike(r"(?i)\btds\b|technical"), text).otherwise(F.concat(text, F.lit(" technical_datasheet")))


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Letters without accents; Spark has no such function."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def ascii_filename(name: Column, most: int = 145) -> Column:
    """A safe file name; `document` if nothing is left."""
    plain = F.regexp_replace(folded(F.try_url_decode(name)), r"[^A-Za-z0-9._()+& \-]+", " ")
    strip = lambda c: F.regexp_replace(c, r"^[ .\-_]+|[ .\-_]+$", "")
    text = strip(F.substring(strip(F.regexp_replace(plain, r"\s+", " ")), 1, most))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("document"))


def is_pdf_body(body: Column, content_type: Column) -> Column:
    return body.startswith(F.lit(b"%PDF")) | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))


def worklist(vendors: DataFrame, statuses: list[str]) -> DataFrame:
    """Vendors of the given statuses with their page limits."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv]), F.col("vendor")), F.lit(DEFAULT_LIMIT))
    return vendors.where(F.col("status").isin(*statuses)).withColumn("product_limit", limit)


def not_captured(candidates: DataFrame, captured: DataFrame) -> DataFrame:
    return candidates.join(captured.select("url"), "url", "left_anti")


def unique_names(files: DataFrame) -> DataFrame:
    """Names that collide get a number in brackets, in order of `ord`."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("name").orderBy("ord"))
    dot = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.withColumn("unique_name", F.when(rank == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), rank.cast("string"), F.lit(")"), dot)))


def material_facets(pages: DataFrame) -> DataFrame:
    """(url, label, facet_url) of a shop's material filters, the first of each label."""
    items = F.regexp_extract_all("html", F.lit(r'(?s)<li[^>]*data-label="[^"]+"[^>]*>.*?</li>'), F.lit(0))
    some = pages.select("url", F.posexplode(F.filter(items, lambda x: F.contains(x, F.lit("amshopby[material][]")))).alias("ord", "x"))
    label = page_space(F.regexp_extract("x", r'data-label="([^"]+)"', 1))
    told = F.replace(F.regexp_extract("x", r'https:\\/\\/[^"}&]+', 0), F.lit("\\/"), F.lit("/"))
    made = F.concat(F.lit("https://colorfabb.us/filaments/"), F.translate(F.lower(label), " -", "__"))
    rows = some.select("url", "ord", label.alias("label"), X.normalize_price_url(F.coalesce(F.nullif(told, F.lit("")), made)).alias("facet_url"))
    first = rows.groupBy("url", F.lower("label").alias("k")).agg(F.min(F.struct("ord", "label", "facet_url")).alias("b"))
    return first.select("url", "b.label", "b.facet_url")
