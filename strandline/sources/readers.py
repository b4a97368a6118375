"""Readers of the record set's sources. Network fetches stay outside: readers take files or fetched pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import units as U
from ..operators.extract import looked_up
from ..operators.stats import first_wins
from .sinks import files

#: Suppliers whose datasheets need their tables read.
TABLE_SUPPLIERS = ("Anycubic", "Bambu Lab", "MatterHackers", "Polymaker", "Prusa Polymers", "Ultimaker")
#: Fields of a slicer profile, the property each one gives, and its unit.
PROFILE_FIELDS = [
    ("filament_density", "density", "g/cm3"), ("temperature_vitrification", "glass_transition", "degC"), ("nozzle_temperature", "nozzle_temperature", "degC"),
    ("nozzle_temperature_initial_layer", "nozzle_temperature", "degC"), ("hot_plate_temp", "bed_temperature", "degC"),
    ("textured_plate_temp", "bed_temperature", "degC"), ("cool_plate_temp", "bed_temperature", "degC"),
    ("filament_max_volumetric_speed", "max_volumetric_speed", "mm3/s"),
]


def scan_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under root by path, with their bytes read only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def read_pdfs(files: DataFrame, tables: bool = False) -> DataFrame:
    """path, text, rows, pages and error of PDF files; without a PDF library every row says so in error."""

    def one(path: str, content: bytes) -> dict:
        try:
            import fitz
        except ImportError:
            return {"path": path, "text": "", "rows": [], "pages": None, "error": "no PDF library is installed"}
        try:
            doc = fitz.open(stream=content, filetype="pdf")
            text = "\n".join(page.get_text() for page in doc)
            rows = []
            if tables:
                try:
                    found = [row for page in doc for t in page.find_tables() for row in t.extract()]
                    rows = [" | ".join(" ".join(c.split()) for c in row if c and c.strip()) for row in found]
                except Exception as failure:  # a table that can't be read is a row that says so
                    rows = [f"table extraction failed: {failure}"]
            return {"path": path, "text": text, "rows": [r for r in rows if r], "pages": doc.page_count, "error": None}
        except Exception as failure:
            return {"path": path, "text": "", "rows": [], "pages": None, "error": str(failure)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.string())), ("pages", pa.int32()), ("error", pa.string())])
        for b in batches:
            yield pa.RecordBatch.from_pylist([one(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], kinds)

    return files.select("path", "content").mapInArrow(run, "path string, text string, rows array<string>, pages int, error string")


def needs_tables(supplier, path):
    return supplier.isin(*TABLE_SUPPLIERS) | F.contains(F.element_at(F.split(path, "/"), -1), F.lit("Bambu"))


def ocr_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """source_file, ocr_text, ocr_rows, mode of a sidecar: a map, or one under `entries`, of texts or objects. A bad file has no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    raw = raw.select(F.coalesce(F.expr("try_variant_get(v, '$.entries', 'variant')"), F.col("v")).alias("v"))
    entries = raw.select(F.expr("try_variant_get(v, '$', 'map<string, variant>')").alias("m")).select(F.explode("m").alias("source_file", "e"))
    plain = F.expr("CASE WHEN schema_of_variant(e) = 'STRING' THEN try_variant_get(e, '$', 'string') END")
    get = lambda p, t: F.expr(f"CASE WHEN schema_of_variant(e) LIKE 'OBJECT%' THEN try_variant_get(e, '$.{p}', '{t}') END")
    rows = F.filter(F.coalesce(get("rows", "array<string>"), F.array().cast("array<string>")), lambda r: r.isNotNull() & (F.trim(r) != ""))
    return entries.select("source_file", F.coalesce(plain, get("text", "string"), F.lit("")).alias("ocr_text"), rows.alias("ocr_rows"), F.coalesce(get("mode", "string"), F.lit("ocr_override")).alias("mode"))


def with_ocr(docs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Sidecar text and rows where a file opened, but has hardly any text and no rows."""
    thin = F.coalesce("error", F.lit("")).eqNullSafe("") & (F.length(F.trim(F.coalesce("text", F.lit("")))) < 80) & (F.size("rows") == 0)
    joined = docs.join(sidecar, "source_file", "left").withColumn("__use", thin & F.col("mode").isNotNull())
    return joined.withColumns(
        {"text": F.when(F.col("__use"), F.col("ocr_text")).otherwise(F.col("text")), "rows": F.when(F.col("__use"), F.col("ocr_rows")).otherwise(F.col("rows"))}
    ).drop("__use", "ocr_text", "ocr_rows")


def profiles(raw: DataFrame) -> DataFrame:
    """Observations of slicer profiles (material_id, json): mapped fields, lists by their first item; bad JSON has none."""
    v = raw.select("material_id", F.try_parse_json("json").alias("v")).where("v IS NOT NULL")
    fields = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(k).alias("key"), F.lit(u).alias("unit"),
            F.coalesce(F.expr(f"try_variant_get(v, '$.{f}[0]', 'string')"), F.expr(f"try_variant_get(v, '$.{f}', 'string')")).alias("raw"),
        )
        for i, (f, k, u) in enumerate(PROFILE_FIELDS)
    ]
    rows = v.select("material_id", F.explode(F.filter(F.array(*fields), lambda x: x["raw"].isNotNull())).alias("p")).select("material_id", "p.*")
    rows = rows.withColumn("canonical", looked_up(3, F.col("key"))).withColumn("n", U.parse_numeric(F.col("raw"), F.col("unit"), F.col("canonical")))
    return rows.select(
        "material_id", F.col("ord").cast("long").alias("ordinal"), F.col("key").alias("property_key"), looked_up(1, F.col("key")).alias("property_label"),
        looked_up(2, F.col("key")).alias("category"), F.col("field").alias("raw_label"), F.col("raw").alias("raw_value"), F.col("unit").alias("unit_raw"),
        F.col("canonical").alias("unit_canonical"), F.col("n.lo").alias("value_min"), F.col("n.hi").alias("value_max"), F.col("n.nominal").alias("value_nominal"),
        F.lit(None).cast("string").alias("test_method"), F.lit(None).cast("string").alias("orientation"), F.lit("slicer profile").alias("condition"),
        F.col("field").alias("source_context"), F.coalesce(F.nullif(F.col("n.flags"), F.lit("")), F.lit("profile_value")).alias("quality_flag"),
    )


def html_specs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a specification sidecar: a list, or one under `entries`."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.expr("try_variant_get(v, '$.entries', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    each = raw.select(F.explode(items).alias("e"))
    get = lambda p, t="string": F.expr(f"try_variant_get(e, '$.{p}', '{t}')").alias(p)
    return each.select(*[get(p) for p in ("supplier", "product", "source_type", "source_url", "source_file", "text")], get("rows", "array<string>"))


def manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first readable, non-empty manifest; a later row of a path replaces an earlier one, paths in / form."""
    for path in sorted(set(paths)):
        try:
            df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
            some = df.where(F.concat_ws("", *df.columns) != "")
            if "local_path" in df.columns and not some.isEmpty():
                keyed = some.withColumn("__line", F.monotonically_increasing_id()).withColumn("path_key", F.translate("local_path", "\\", "/"))
                return first_wins(keyed, ["path_key"], [-F.col("__line")]).drop("__line")
        except PySparkException:  # an unreadable manifest is passed over
            continue
    return spark.createDataFrame([], "local_path string, source_page_url string, download_url string, document_title string, retrieved_at string, path_key string")


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(materials, observations) of a published document."""
    doc = spark.read.option("multiLine", True).json(path)
    each = doc.select(F.posexplode("materials").alias("ordinal", "m")).select("ordinal", "m.*")
    obs = each.select("material_id", "supplier", "product", "source_file", F.posexplode("observations").alias("obs_ordinal", "o"))
    return each.drop("observations"), obs.select("material_id", "supplier", "product", "source_file", "obs_ordinal", "o.*")


def sitemap(pages: DataFrame) -> DataFrame:
    """(url, loc) of fetched sitemaps (url, xml), with or without a namespace."""
    found = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?loc\s*>\s*([^<]+?)\s*</(?:\w+:)?loc\s*>"), F.lit(1))
    return pages.select("url", F.explode(found).alias("loc"))


def seeds(targets: DataFrame, extra: DataFrame) -> DataFrame:
    """(vendor, url, hint_product, source): nested target addresses, then fixed ones; repeats stay."""
    own = targets.select("vendor", F.explode("source_urls").alias("url"), F.lit("").alias("hint_product"), F.lit("target_seed").alias("source"))
    return own.unionByName(extra.select("vendor", "url", F.lit("").alias("hint_product"), F.lit("extra_seed").alias("source")))


def sidecar_candidates(specs: DataFrame) -> DataFrame:
    """(vendor, url, hint, source, place) of a sidecar's entries that name a supplier and an address, in its order."""
    some = specs.withColumn("place", F.monotonically_increasing_id()).withColumns({"vendor": X.squeeze(F.coalesce("supplier", F.lit(""))), "hint": X.squeeze(F.coalesce("product", F.lit("")))})
    some = some.where((F.col("vendor") != "") & (F.coalesce("source_url", F.lit("")) != ""))
    return some.select("vendor", X.normalize_price_url(F.col("source_url")).alias("url"), "hint", F.lit("html_material_specs").alias("source"), "place")


def sidecar_mass(specs: DataFrame) -> DataFrame:
    """(url, kg, mass_source): the largest mass of a page's net weight, diameter or length rows."""
    rows = specs.select(X.normalize_price_url(F.col("source_url")).alias("url"), F.explode("rows").alias("row")).where(F.col("row").rlike("^(Net Weight|Diameter|Filament Length)"))
    m = rows.withColumn("m", U.largest_mass(F.col("row"))).where("m IS NOT NULL")
    best = m.groupBy("url").agg(F.max_by("m", F.col("m.kg")).alias("m"))
    return best.select("url", F.round("m.kg", 6).alias("kg"), F.concat(F.lit("html_sidecar:"), "m.raw").alias("mass_source"))


def exchange_rates(currencies: DataFrame, rates: DataFrame, today: str) -> DataFrame:
    """(currency, rate, date, source) of each currency met; dollars are their own."""
    met = currencies.select("currency").where("currency <> '' AND currency <> 'USD'").distinct().join(rates, "currency")
    own = currencies.sparkSession.createDataFrame([("USD", 1.0, today, "identity")], "currency string, rate double, date string, source string")
    return own.unionByName(met.select("currency", "rate", "date", "source"))


def loaded(spark: SparkSession, root: str, wanted: Sequence[str] = (), pattern: str = "*.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(materials, observations, status) of all published documents under a folder, bad ones told and passed over.

    Each document is read as text and parsed permissively: what is no JSON, or has no list of
    materials, becomes a status row. `wanted` files that aren't there become one, too, and a
    folder that isn't there is one without files. status: file (its path under root), status
    (ok, broken, no_materials, missing), materials.
    """
    fs, at = files(spark, root)
    if fs.exists(at(root)):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
        above = re.escape(fs.makeQualified(at(root)).toUri().getRawPath().rstrip("/"))  # paths of files come with their odd characters escaped
        name = lambda c: F.try_url_decode(F.regexp_replace(F.regexp_replace(c, f"^.*?{above}/", ""), r"\+", "%2B")).alias("file")
        there = spark.createDataFrame([(f,) for f in raw.inputFiles()], "path string").select(name("path"))  # Spark's own listing: scans pass over empty files
        raw = raw.select(name("_metadata.file_path"), F.try_parse_json(F.make_valid_utf8(F.col("content").cast("string"))).alias("doc"))
    else:
        raw = spark.createDataFrame([], "file string, value string").select("file", F.try_parse_json("value").alias("doc"))
        there = raw.select("file")
    listed = there.join(raw, "file", "left").withColumn("list", F.try_variant_get(F.col("doc"), "$.materials", "array<variant>"))
    state = F.when(F.col("doc").isNull(), "broken").when(F.col("list").isNull(), "no_materials").otherwise("ok")
    status = listed.select("file", state.alias("status"), F.coalesce(F.size("list"), F.lit(0)).alias("materials"))
    if wanted:
        asked = spark.createDataFrame([(f,) for f in wanted], "file string")
        status = status.unionByName(asked.join(there, "file", "left_anti").select("file", F.lit("missing").alias("status"), F.lit(0).alias("materials")))
    get = lambda v, p, t="string": F.try_variant_get(F.col(v), f"$.{p}", t)
    each = listed.select("file", F.posexplode("list").alias("ordinal", "m"))
    named = each.select("file", "ordinal", *[get("m", c).alias(c) for c in ("material_id", "supplier", "product", "base_material", "status")], get("m", "observations", "array<variant>").alias("obs"))
    rows = named.select("file", "material_id", F.posexplode("obs").alias("obs_ordinal", "o"))
    obs = rows.select("file", "material_id", "obs_ordinal", *[get("o", c).alias(c) for c in ("property_key", "raw_value", "unit_canonical", "orientation")], get("o", "value_nominal", "double").alias("value_nominal"))
    return named.drop("obs"), obs, status
