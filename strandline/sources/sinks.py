"""Writers: tables, nested documents, flat files and short reports. Reports hold a bounded number of rows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import issues as I
from ..operators.stats import top_per_group


def write_verified(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write tables and read them again: an error where rows are missing, keys repeat, or an observation has no material."""
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{root}/{name}").count()
        if counts[name] != seen.get["n"]:
            raise ValueError(f"{name}: {seen.get['n']} rows written, {counts[name]} read")
    read = next(iter(tables.values())).sparkSession.read.parquet
    materials = read(f"{root}/materials")
    if counts["materials"] != materials.select("material_id").distinct().count():
        raise ValueError("materials share an id")
    if not read(f"{root}/observations").join(materials, "material_id", "left_anti").isEmpty():
        raise ValueError("observations without a material")
    return counts


def files(spark: SparkSession, path: str):
    """The file system of a path, and what makes its path objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def point(spark: SparkSession, path: str, version: str, keep: int = 2) -> None:
    """Make `version` the one that is read: the next pointer is created, which only one publication can; old versions go."""
    fs, at = files(spark, path)
    turns = sorted(int(x.getPath().getName().split("-")[1]) for x in fs.listStatus(at(path)) if x.getPath().getName().startswith("current-"))
    turn = (turns[-1] if turns else 0) + 1
    try:
        out = fs.create(at(f"{path.rstrip('/')}/current-{turn}"), False)
    except Py4JJavaError as e:
        raise ValueError("another publication came first") from e
    out.write(bytearray(version.encode()))
    out.close()
    live = {version} | {read_small(spark, f"{path.rstrip('/')}/current-{t}") for t in turns[len(turns) - keep + 1 :] if keep > 1}
    for x in fs.listStatus(at(path)):
        name = x.getPath().getName()
        if (name.startswith("v-") and name not in live) or (name.startswith("current-") and int(name.split("-")[1]) <= turn - max(1, keep)):
            fs.delete(x.getPath(), True)


def read_small(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row[0].strip() if row else ""


def pointed(spark: SparkSession, path: str) -> str:
    """The version that the newest pointer names."""
    fs, at = files(spark, path)
    turns = [int(x.getPath().getName().split("-")[1]) for x in fs.listStatus(at(path)) if x.getPath().getName().startswith("current-")]
    if not turns:
        raise ValueError(f"nothing is published under {path}")
    for turn in sorted(turns, reverse=True):
        if version := read_small(spark, f"{path.rstrip('/')}/current-{turn}"):  # one that is just being made is empty
            return version
    raise ValueError(f"nothing is published under {path}")


def write_tables(materials: DataFrame, definitions: DataFrame, obs: DataFrame, path: str) -> None:
    """Three normalised tables in a folder of their own: written beside it, verified, and only then put in its place.

    `build.publish` goes further: readers follow a pointer and never meet a missing folder.
    """
    spark = obs.sparkSession
    fs, at = files(spark, path)
    turn = uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}__staged-{turn}", f"{path.rstrip('/')}__old-{turn}"
    write_verified({"materials": materials, "property_definitions": definitions, "observations": obs}, staged)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise ValueError(f"{path} can't be replaced")
    if not fs.rename(at(staged), at(path)):
        raise ValueError(f"{path} can't be put in place")
    fs.delete(at(old), True)


def long_rows(materials: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations with their record's columns."""
    record = materials.withColumn("modifiers", F.to_json("modifiers")).drop("quality_notes", "status", "pages")
    return record.join(obs, "material_id").drop("ordinal")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def nested(materials: DataFrame, obs: DataFrame) -> DataFrame:
    """One row a record with its observations in order."""
    fields = [c for c in obs.columns if c != "material_id"]
    grouped = obs.groupBy("material_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"]))).alias("observations"))
    return materials.join(grouped, "material_id", "left").withColumn("observations", F.coalesce("observations", F.array()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def coverage_report(coverage: DataFrame) -> str:
    """A table of at most one line a property."""
    rows = coverage.select("property_key", "materials", "observations", *[X.significant(F.col(c)).alias(c) for c in ("min_value", "median_value", "max_value")]).orderBy("property_key").collect()
    head = "| property | materials | observations | min | median | max |\n|-|-|-|-|-|-|\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def rejection_report(rejections: DataFrame, limit: int = 500) -> str:
    rows = rejections.orderBy("material_id", "property_key", "raw_value", "reason").limit(limit).collect()
    line = lambda v: str(v or "").replace("|", "/")
    return "| record | property | value | reason |\n|-|-|-|-|\n" + "".join(f"| {line(r.material_id)} | {line(r.property_key)} | {line(r.raw_value)} | {line(r.reason)} |\n" for r in rows)


def issue_examples(issues: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """The first issues of each confidence and type: 8 sure and medium ones, 10 uncertain ones."""
    most = most or {"high": 8, "medium": 8, "uncertain": 10}
    order = [F.col(c) for c in ("supplier", "product", "property_key", "raw_value", "issue_id")]
    cap = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    ranked = top_per_group(issues, ["confidence", "issue_type"], order, max(most.values()))
    return ranked.where(F.col("rank") <= F.try_element_at(cap, F.col("confidence")))


def write_issues(issues: DataFrame, path: str) -> bool:
    """CSV, JSON and counts of issues; nothing is written for none."""
    if issues.isEmpty():
        return False
    write_csv(issues, f"{path}/issues_csv")
    write_json(issues, f"{path}/issues")
    write_json(I.counts(issues), f"{path}/counts")
    write_text(issues.sparkSession, issue_report(issues), f"{path}/report")
    return True


def issue_report(issues: DataFrame) -> str:
    """Counts by confidence and type, largest first within a confidence, then the first examples of each type."""
    kinds = issues.groupBy("confidence", "issue_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("material_id").alias("materials"))
    rank = I.confidence_rank(F.col("confidence"))
    rows = kinds.orderBy(rank, F.desc("n"), "issue_type").collect()  # a row a type
    cell = lambda v: str("" if v is None else v).replace("|", "/").replace("\n", " ")
    out = ["# Property issues", "", "| confidence | type | issues | records |", "|-|-|-|-|"]
    out += [f"| {r.confidence} | {r.issue_type} | {r.n} | {r.materials} |" for r in rows]
    shown = issue_examples(issues).orderBy(rank, "issue_type", "rank").collect()  # a few a type
    for r in rows:
        out += ["", f"## {r.issue_type} ({r.confidence})", "", "| id | supplier | product | property | value | context |", "|-|-|-|-|-|-|"]
        own = [x for x in shown if (x.confidence, x.issue_type) == (r.confidence, r.issue_type)]
        out += ["| " + " | ".join(cell(v) for v in (x.issue_id, x.supplier, x.product, x.property_key, x.raw_value, x.source_context)) + " |" for x in own]
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short report as one text file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_prices(prices: DataFrame, run_log: DataFrame, path: str) -> None:
    """Rows, log, vendor rollup and status histogram."""
    from ..operators.prices import vendor_rollup

    write_csv(prices, f"{path}/prices")
    write_csv(run_log, f"{path}/run_log")
    write_json(vendor_rollup(prices), f"{path}/vendors")
    status = run_log.groupBy(F.concat_ws(":", "action", "status").alias("action_status")).agg(F.count(F.lit(1)).alias("n"))
    write_json(status, f"{path}/statuses")
    write_json(price_summary(prices, run_log), f"{path}/summary")


def price_summary(prices: DataFrame, run_log: DataFrame) -> DataFrame:
    """One row: totals, and the histogram of actions and statuses as a map."""
    totals = prices.agg(
        F.count(F.lit(1)).alias("price_rows"), F.countDistinct("vendor").alias("vendors"), F.countDistinct("url").alias("urls"),
        F.count("mass_kg").alias("with_mass"), F.count("price_usd").alias("with_usd"),
    )
    status = run_log.groupBy(F.concat_ws(":", "action", "status").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    held = status.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("statuses"))  # a few kinds of step
    return totals.crossJoin(held)  # one row each


def append_prices(prices: DataFrame, path: str) -> DataFrame:
    """Rows of urls that earlier runs haven't written yet, added to what is there: a run that broke off goes on from there.

    Returns all rows written so far. An append is a new set of files, and a url's rows go in one append.
    """
    spark = prices.sparkSession
    fs, at = files(spark, path)
    fresh = prices
    if fs.exists(at(f"{path}/_SUCCESS")):
        fresh = prices.join(spark.read.schema(prices.schema).parquet(path).select("url").distinct(), "url", "left_anti").select(*prices.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(prices.schema).parquet(path)


def check(issues: DataFrame, most: int = 50) -> tuple[int, list]:
    """How many issues there are, and the first ones."""
    return issues.count(), issues.limit(most).collect()
