"""From read sources to a published record set: one call joins readers, extraction and writers.

A source frame has a row a datasheet: source_file, text, rows, pages, error; profiles and
HTML entries come beside it. Materials get their class and status, observations their
material, and publication writes a new version, verifies it, and only then points to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import stats as S
from ..operators.extract import extract
from ..operators.ordinals import running_ids
from ..schemas import OBSERVATION_COLUMNS, properties
from ..scratch import written
from . import readers, sinks

#: Texts below these lengths get a note, and suppliers' pages without any properties.
SHORT_TEXT = 300


def records(docs: DataFrame, source_type: str) -> DataFrame:
    """Material records without a status: docs has source_file, text, rows, pages, error, and supplier and product where they are known."""
    named = docs if "supplier" in docs.columns else docs.withColumn("supplier", X.supplier_from_path(F.col("source_file")))
    if "product" not in docs.columns:
        file = X.product_from_file(F.element_at(F.split("source_file", "/"), -1), F.col("supplier"))
        named = named.withColumn("product", X.product_from_text(F.coalesce("text", F.lit("")), file))
    named = named.withColumn("source_type", F.lit(source_type))
    kind = C.classify_material(F.col("product"))
    key = F.concat_ws("\n", "source_type", "source_file", "supplier", "product")
    return named.withColumn("material_id", F.substring(F.sha1(key), 1, 16)).withColumns(
        {"base_material": kind["base"], "material_family": kind["family"], "modifiers": kind["modifiers"]}
    )


def with_status(materials: DataFrame, counts: DataFrame) -> DataFrame:
    """Status and notes; counts has material_id and n, its observations."""
    joined = materials.join(counts, "material_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = F.size(F.coalesce("rows", F.array().cast("array<string>")))
    skip = X.skip_reason(F.element_at(F.split("source_file", "/"), -1))
    status = X.record_status(F.col("error"), F.col("text"), rows, F.col("pages"), F.col("supplier"), F.col("n"), skip)
    profile = F.col("source_type") == "json_profile"  # has numbers and no text of its own
    made = joined.withColumn("status", F.when(profile & (F.col("n") > 0), "parsed").otherwise(status))
    short = ~profile & (F.col("status") == "parsed") & (F.length(F.trim(F.coalesce("text", F.lit("")))) < SHORT_TEXT)
    note = F.when(F.col("status") == "error", F.col("error")).when(F.col("status") == "skipped", skip).when(short, "short text").otherwise("")
    return made.withColumn("quality_notes", F.coalesce(note, F.lit("")))


def build(docs: DataFrame, specs: DataFrame | None = None, slicer: DataFrame | None = None) -> dict[str, DataFrame]:
    """materials, observations, rejections and property_definitions of datasheets, HTML entries and slicer profiles.

    docs: source_file, text, rows, pages, error. specs: supplier, product, source_file, text,
    rows. slicer: source_file, json. Skipped files keep their record and are not read.
    """
    spark = docs.sparkSession
    parts = [records(docs, "pdf")]
    blank = {"pages": F.lit(None).cast("int"), "error": F.lit(None).cast("string")}
    if specs is not None:
        parts.append(records(specs.select("supplier", "product", "source_file", "text", "rows").withColumns(blank), "html_spec"))
    fields = ["material_id", "supplier", "product", "base_material", "material_family", "modifiers", "source_type", "source_file", "pages", "text", "rows", "error"]
    found = parts[0].select(*fields)
    for p in parts[1:]:
        found = found.unionByName(p.select(*fields))
    live = found.where((X.skip_reason(F.element_at(F.split("source_file", "/"), -1)) == "") & (F.coalesce("error", F.lit("")) == ""))
    observations, rejections = extract(live.select("material_id", "text", "rows"))
    # read several times below and by the caller: tables in the shared folder, so that no text is extracted twice
    observations, rejections = written(observations.select(*OBSERVATION_COLUMNS)), written(rejections)
    if slicer is not None:
        plain = slicer.withColumns({"text": F.lit(""), "rows": F.array().cast("array<string>")} | blank)
        more = records(plain, "json_profile")
        read = readers.profiles(more.select("material_id", "json"))
        observations = observations.unionByName(read.select(*OBSERVATION_COLUMNS))
        # a profile without a mapped field is no record
        held = more.join(read.select("material_id").distinct(), "material_id", "left_semi")
        found = found.unionByName(held.select(*fields))
    counts = observations.groupBy("material_id").agg(F.count(F.lit(1)).alias("n"))
    materials = with_status(found, counts).select(*fields[:9], "status", "quality_notes")
    return {"materials": materials, "observations": observations, "rejections": rejections, "property_definitions": properties(spark)}


def numbered(made: dict[str, DataFrame]) -> DataFrame:
    """Observations with a gapless observation_id: datasheets by path, then the other sources, each record's rows in their order."""
    kind = F.array_position(F.array(*[F.lit(k) for k in ("pdf", "json_profile", "html_spec")]), F.col("source_type"))
    place = made["materials"].select("material_id", kind.alias("__kind"), F.col("source_file").alias("__file"))
    rows = made["observations"].join(place, "material_id", "left")  # one without a record fails the verification
    order = [F.col("__kind"), F.col("__file"), F.col("material_id"), F.col("ordinal")]
    return running_ids(rows, order, "observation_id").drop("__kind", "__file")


def publish(made: dict[str, DataFrame], path: str, keep: int = 2) -> str:
    """Write the tables of `build` as a new version, verify what was written, then point to it; readers never see a half-written set.

    The coverage of each property is worked out from the written observations. The pointer is
    one small file, made by a rename. The last `keep` versions stay. Returns the version.
    """
    spark = made["materials"].sparkSession
    version = f"v-{uuid.uuid4().hex}"
    root = f"{path.rstrip('/')}/{version}"
    sinks.write_verified(made | {"observations": numbered(made)}, root)
    obs = spark.read.parquet(f"{root}/observations").withColumnRenamed("value_nominal", "value")
    S.coverage(obs, spark.read.parquet(f"{root}/property_definitions")).write.parquet(f"{root}/coverage")
    sinks.point(spark, path, version, keep)
    return version


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the version that is pointed to."""
    root = f"{path.rstrip('/')}/{sinks.pointed(spark, path)}"
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("materials", "observations", "rejections", "property_definitions", "coverage")}


def export(read: dict[str, DataFrame], path: str) -> None:
    """The flat files of a published set: long CSV, nested JSON, coverage and rejection reports."""
    spark = read["materials"].sparkSession
    sinks.write_csv(sinks.long_rows(read["materials"], read["observations"]), f"{path}/long")
    sinks.write_json(sinks.nested(read["materials"], read["observations"]), f"{path}/nested")
    sinks.write_text(spark, sinks.coverage_report(read["coverage"]), f"{path}/coverage")
    sinks.write_text(spark, sinks.rejection_report(read["rejections"]), f"{path}/rejections")
