"""A collector's run over fetched pages: from a vendor's seeds to its product pages, their datasheet links and rows.

Fetching stays outside: `pages` holds what was fetched, and a page that isn't there is a failed
fetch. The link graph is walked breadth first. A round joins the frontier to the pages, parses
the pages met, and takes the links that look like product pages; those that the vendor has
visited before are anti-joined away, the first link to a page counts, and the earliest are
admitted up to the vendor's limit. Frontier, visited pages and parsed pages are tables in the
shared folder, so that a lost executor never takes a run back to its seeds.

Every step leaves a row in the run log beside its result, made from the same parsed pages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.stats import first_wins
from ..scratch import drop_table, written
from . import collect, html
from .sinks import write_csv, write_json

#: Slices in which a vendor's new links are ranked first, so that a vendor with most of them is cut down by many tasks.
SLICES = 64


@dataclass
class Run:
    """What a run found. `visits` has a row a visited page, in order of (round, place)."""

    visits: DataFrame  # vendor, url, round, place, found, title
    datasheets: DataFrame  # vendor, page_url, url, file_name: each once a vendor
    entries: DataFrame  # supplier, product, source_type, source_url, source_file, rows, text
    snapshots: DataFrame  # source_file, html
    log: DataFrame  # vendor, source_url, action, status, detail, output_file


def keyed(pages: DataFrame) -> DataFrame:
    """(url, html) by the address without query; of several fetches the first by the whole address."""
    some = pages.select(X.normalize_price_url(F.col("url")).alias("url"), F.col("url").alias("whole"), "html")
    return first_wins(some, ["url"], [F.col("whole"), F.xxhash64("html")]).drop("whole")


def admitted(links: DataFrame, visited: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """The links (vendor, url, place) that a round may follow: unseen, each once, the earliest up to what is left of the vendor's limit."""
    fresh = links.groupBy("vendor", "url").agg(F.min("place").alias("place")).join(visited.select("vendor", "url"), ["vendor", "url"], "left_anti")
    used = visited.where("round > 0").groupBy("vendor").agg(F.count(F.lit(1)).alias("used"))
    left = F.coalesce("product_limit", F.lit(default)) - F.coalesce("used", F.lit(0))
    some = fresh.join(limits.select("vendor", "product_limit"), "vendor", "left").join(used, "vendor", "left").withColumn("__left", left)
    some = some.withColumn("__slice", F.pmod(F.xxhash64("url"), F.lit(SLICES)))
    for by in (["vendor", "__slice"], ["vendor"]):
        some = some.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy("place", "url"))).where("__rank <= __left")
    return some.select("vendor", "url", F.col("__rank").alias("place"))


def crawl(pages: DataFrame, seeds: DataFrame, limits: DataFrame, rounds: int = 1, default: int = collect.DEFAULT_LIMIT, follows: Callable[[Column, Column, Column], Column] = collect.is_product_page) -> Run:
    """Walk from seeds (vendor, url, place) over pages (url, html), `rounds` links deep; limits (vendor, product_limit) counts product pages a vendor.

    A place in a round tells the order: seeds by their own, links by their page's place and their order on it.
    """
    store = written(keyed(pages))
    start = first_wins(seeds.select("vendor", X.normalize_price_url(F.col("url")).alias("url"), F.col("place").cast("long").alias("place")), ["vendor", "url"], [F.col("place")])
    frontier = written(start.withColumn("round", F.lit(0)))
    visited, seen, parts = frontier, None, []
    for r in range(rounds + 1):
        met = store.join(frontier.select("url").distinct(), "url", "left_semi")
        parsed = written(html.parse_pages(met))
        parts.append((frontier, parsed))
        if r == rounds:
            break
        here = frontier.join(html.page_links(parsed, keep_query=False), "url").where(follows(F.col("vendor"), F.col("link"), F.col("text")))
        links = here.select("vendor", F.col("link").alias("url"), F.struct("place", "ord").alias("place"))
        frontier = written(admitted(links, visited, limits, default).select("vendor", "url", F.col("place").cast("long").alias("place"), F.lit(r + 1).alias("round")))
        if frontier.isEmpty():
            break
        seen, visited = visited, written(visited.unionByName(frontier))
        if r:
            drop_table(seen)
    drop_table(store)
    return gathered(parts)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def gathered(parts: list[tuple[DataFrame, DataFrame]]) -> Run:
    """The run's tables from each round's frontier and parsed pages."""
    walked = union([f for f, _ in parts])
    parsed = first_wins(union([p for _, p in parts]), ["url"], [F.xxhash64("html")]) if len(parts) > 1 else parts[0][1]
    titled = parsed.withColumn("page_title", html.first_title(F.col("url")))
    visits = written(walked.join(titled.select("url", F.col("page_title").alias("title")), "url", "left").withColumn("found", F.col("title").isNotNull()))
    rows = html.spec_rows(parsed).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "row"))), lambda x: x["row"]).alias("rows"))  # of one page
    product = collect.is_product_page(F.col("vendor"), F.col("url"), F.lit(""))
    told = visits.where("found").where(product).join(rows, "url", "left")
    name = F.concat(collect.ascii_filename(F.concat_ws(" ", "vendor", "title"), 120), F.lit("_"), F.substring(F.sha1("url"), 1, 8), F.lit(".html"))
    told = written(told.withColumn("n", F.coalesce(F.size("rows"), F.lit(0))).withColumn("file", F.when(F.col("n") > 0, name)))
    # a page that several vendors reach is one entry, of the first that came
    first = first_wins(told.where("n > 0"), ["url"], [F.col("round"), F.col("place"), F.col("vendor")])
    entries = written(first.select(
        F.col("vendor").alias("supplier"), F.col("title").alias("product"), F.lit("official_html_specs").alias("source_type"), F.col("url").alias("source_url"),
        F.col("file").alias("source_file"), "rows", F.concat_ws("\n", F.array(F.col("title")), F.col("rows")).alias("text"),
    ))
    linked = visits.select("vendor", "url", "round", "place").join(html.page_links(parsed), "url").where(collect.is_datasheet_link(F.col("text"), F.col("link")))
    linked = linked.join(visits.select("vendor", "url", "title"), ["vendor", "url"])
    sheet = linked.select("vendor", F.col("url").alias("page_url"), F.col("link").alias("url"), collect.datasheet_label(F.col("title"), F.col("text"), F.col("link")).alias("label"), F.struct("round", "place", "ord").alias("at"))
    sheets = first_wins(sheet, ["vendor", "url"], [F.col("at")]).drop("at")
    sheets = written(sheets.withColumn("file_name", F.concat(collect.ascii_filename(F.col("label"), 120), F.lit(".pdf"))).drop("label"))
    return Run(visits, sheets, entries, entries.join(parsed, entries["source_url"] == parsed["url"]).select("source_file", "html"), run_log(visits, told, entries, sheets))


def run_log(visits: DataFrame, told: DataFrame, entries: DataFrame, sheets: DataFrame) -> DataFrame:
    """A row a step: each fetch, each product page's extraction, each datasheet link."""
    none = F.lit("")
    fetch = F.when(F.col("round") == 0, "fetch_seed").otherwise("fetch_product")
    fetched = visits.select("vendor", F.col("url").alias("source_url"), fetch.alias("action"), F.when(F.col("found"), "ok").otherwise("error").alias("status"), F.when(F.col("found"), F.col("title")).otherwise("not fetched").alias("detail"), none.alias("output_file"))
    own = entries.select(F.col("source_url").alias("url"), F.col("supplier").alias("vendor"), F.lit(True).alias("own"))
    status = F.when(F.col("n") == 0, "no_rows").when(F.col("own"), "saved").otherwise("duplicate")
    detail = F.when(F.col("n") == 0, F.col("title")).when(F.col("own"), F.concat("n", F.lit(" rows"))).otherwise("already captured")
    kept = told.join(own, ["url", "vendor"], "left").select("vendor", F.col("url").alias("source_url"), F.lit("extract_html_specs").alias("action"), status.alias("status"), detail.alias("detail"), F.when(status == "saved", F.col("file")).otherwise("").alias("output_file"))
    linked = sheets.select("vendor", F.col("url").alias("source_url"), F.lit("datasheet_link").alias("action"), F.lit("found").alias("status"), F.col("page_url").alias("detail"), F.col("file_name").alias("output_file"))
    return fetched.unionByName(kept).unionByName(linked)


def summary(run: Run) -> DataFrame:
    """(vendor, action, status, n): the nested histogram of a run as rows."""
    return run.log.groupBy("vendor", "action", "status").agg(F.count(F.lit(1)).alias("n"))


def write_run(run: Run, path: str, generated_at: str) -> None:
    """The sidecar (one JSON object an entry), the run log as CSV, page snapshots, datasheet links and the histogram."""
    write_json(run.entries.withColumn("generated_at", F.lit(generated_at)), f"{path}/entries")
    write_csv(run.log.select(F.lit(generated_at).alias("timestamp"), "*"), f"{path}/run_log")
    run.snapshots.write.mode("overwrite").parquet(f"{path}/snapshots")
    write_json(run.datasheets, f"{path}/datasheets")
    by = summary(run).groupBy("vendor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "action", "status").alias("k"), "n")))).alias("statuses"))  # a few kinds of step
    write_json(by, f"{path}/summary")
