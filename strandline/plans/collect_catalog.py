"""Queries of collecting: a crawl over a link graph, one-pass harvests, product documents, running ids, growing rollups.

The sites are derived from the tables: pages link to pages by arithmetic on their ids, and
shops sell the lines of orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordinals import running_ids
from ..operators.prices import add_usd
from ..scratch import folder, spread, tasks
from ..sources import crawl as K
from ..sources import harvest as H
from ..sources import product_json as J
from ..streaming import outputs as O
from .catalog import OBS, OFFERS, RATES, observations, offers, query, table


@query(f"""WITH {OBS} SELECT ordinal, property_key, row_number() OVER (ORDER BY ordinal, property_key) AS observation_id FROM obs""")
def running_id(spark, sf):
    """Every observation's id in insertion order."""
    rows = observations(spark, sf).select("ordinal", "property_key")
    return running_ids(rows, [F.col("ordinal"), F.col("property_key")], "observation_id")


#: How deep the crawl goes, and how many product pages a vendor may have; every third vendor has fewer.
ROUNDS, LIMIT, SMALL_LIMIT = 6, 25, 4

SITE = """site AS (
  SELECT page_id, host, regexp_replace(host, '^(www|m|blog)\\.', '') AS vendor,
    'https://' || host || '/products/' || CASE WHEN page_id % 7 = 3 THEN 'spare-nozzle-' ELSE 'pla-' END || page_id AS url
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)),
edges AS (
  SELECT p.url AS page, e.ord, q.url AS url FROM site p, LATERAL (VALUES (0, 2 * p.page_id + 1), (1, 2 * p.page_id + 2), (2, p.page_id // 3)) e(ord, to_id) JOIN site q ON q.page_id = e.to_id
  UNION ALL SELECT url, 3, 'https://' || host || '/products/pla-lost-' || page_id FROM site WHERE page_id % 5 = 0),
limits AS (SELECT vendor, CASE WHEN length(vendor) % 3 = 0 THEN 4 ELSE 25 END AS product_limit FROM site GROUP BY 1),
r0 AS (SELECT vendor, arg_min(url, page_id) AS url, 0 AS round, min(page_id) AS place FROM site GROUP BY 1)"""


def _walk() -> str:
    steps = [SITE]
    for r in range(ROUNDS):
        visited = " UNION ALL ".join(f"SELECT vendor, url, round FROM r{k}" for k in range(r + 1))
        steps.append(f"""r{r + 1} AS MATERIALIZED (
  SELECT vendor, url, {r + 1} AS round, row_number() OVER (PARTITION BY vendor ORDER BY first_at, url) AS place
  FROM (SELECT f.vendor, e.url, min(row(f.place, e.ord)) AS first_at FROM r{r} f JOIN edges e ON e.page = f.url WHERE e.url LIKE '%/products/pla-%' GROUP BY 1, 2) l
  WHERE NOT EXISTS (SELECT 1 FROM ({visited}) v WHERE v.vendor = l.vendor AND v.url = l.url)
  QUALIFY place <= (SELECT product_limit FROM limits x WHERE x.vendor = l.vendor) - (SELECT count(*) FROM ({visited}) v WHERE v.vendor = l.vendor AND v.round > 0))""")
    every = " UNION ALL ".join(f"SELECT vendor, url, round, place FROM r{k}" for k in range(ROUNDS + 1))
    steps.append(f"visits AS MATERIALIZED (SELECT a.*, s.page_id, s.page_id IS NOT NULL AS found FROM ({every}) a LEFT JOIN site s USING (url))".replace("a.*, s.page_id", "a.vendor, a.url, a.round, a.place, s.page_id"))
    return ",\n".join(steps)


WALK = _walk()


def site(spark, sf):
    """The derived site: page_id, host, vendor, url and html of every page."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    kind = F.when(F.col("page_id") % 7 == 3, "spare-nozzle-").otherwise("pla-")
    base = table(spark, sf, "pages").select("page_id", host.alias("host"))
    base = base.withColumns({"vendor": F.regexp_replace("host", r"^(www|m|blog)\.", ""), "url": F.concat(F.lit("https://"), "host", F.lit("/products/"), kind, "page_id")})
    p = F.col("page_id")
    to = F.posexplode(F.array(2 * p + 1, 2 * p + 2, F.floor(p / 3)))
    ends = base.select("page_id", to.alias("ord", "to_id")).join(base.select(p.alias("to_id"), F.col("url").alias("to_url")), "to_id")
    links = ends.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "to_url", "to_id"))).alias("links"))  # three at most
    own = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit('<a href="'), x["to_url"], F.lit('">Item '), x["to_id"], F.lit("</a>"))))
    lost = F.when(p % 5 == 0, F.concat(F.lit('<a href="/products/pla-lost-'), p, F.lit('">Item</a>'))).otherwise("")
    sheet = F.when(p % 4 == 0, F.concat(F.lit('<a href="/files/tds-'), p, F.lit('.pdf">TDS</a>'))).otherwise("")
    spec = F.when(p % 2 == 0, "<table><tr><td>Density</td><td>1.24 g/cm3</td></tr></table>").otherwise("")
    page = F.concat(F.lit("<html><title>x</title><h1>Maker PLA page "), p, F.lit("</h1>"), spec, own, lost, sheet, F.lit('<a href="#top">up</a></html>'))
    return base.join(links, "page_id", "left").withColumn("html", page).select("page_id", "host", "vendor", "url", "html")


def walked(spark, sf) -> K.Run:
    pages = site(spark, sf)
    seeds = pages.groupBy("vendor").agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("place"))
    limits = pages.select("vendor").distinct().withColumn("product_limit", F.when(F.length("vendor") % 3 == 0, SMALL_LIMIT).otherwise(LIMIT))
    return K.crawl(pages.select("url", "html"), seeds, limits, ROUNDS)


@query(f"WITH {WALK} SELECT vendor, url, round, place, found FROM visits")
def site_crawl(spark, sf):
    """Every page that each vendor's crawl meets, with its round and place."""
    return walked(spark, sf).visits.select("vendor", "url", "round", F.col("place").cast("long").alias("place"), "found")


@query(f"""WITH {WALK}, steps AS (
  SELECT vendor, CASE WHEN round = 0 THEN 'fetch_seed' ELSE 'fetch_product' END AS action, CASE WHEN found THEN 'ok' ELSE 'error' END AS status FROM visits
  UNION ALL SELECT vendor, 'extract_html_specs', CASE WHEN page_id % 2 = 1 THEN 'no_rows' WHEN row_number() OVER (PARTITION BY url ORDER BY round, place, vendor) = 1 THEN 'saved' ELSE 'duplicate' END
  FROM visits WHERE found AND url LIKE '%/products/pla-%'
  UNION ALL SELECT vendor, 'datasheet_link', 'found' FROM visits WHERE found AND page_id % 4 = 0)
SELECT vendor, action, status, count(*) AS n FROM steps GROUP BY ALL""")
def crawl_log(spark, sf):
    """The run log's histogram."""
    return K.summary(walked(spark, sf))


SHOP = """shop AS (SELECT o_orderkey AS k, 'https://shop-' || o_custkey % 7 || '.example.com/products/pla-' || o_orderkey AS url, 'shop-' || o_custkey % 7 AS vendor FROM orders),
line AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord,
  l_linenumber AS no, l_partkey AS part, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_extendedprice END AS raw, l_tax AS tax, l_returnflag AS flag FROM lineitem),
priced AS (SELECT *, CASE WHEN raw > 200 THEN raw / 100 ELSE raw END AS price FROM line)"""


#: Pages a task makes and reads, about: what bounds the memory of its sorts.
TASK_PAGES = 100_000


def shop(spark, sf):
    """Orders as product pages: k, vendor, url and `lines` (ord, no, part, raw, tax, flag) of each; orders and lines are spread by order first, for each page is much work."""
    orders = table(spark, sf, "orders")
    n = tasks(orders, TASK_PAGES)
    order = spread(orders, "o_orderkey", n=n).select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("shop-"), F.col("o_custkey") % 7).alias("vendor"),
        F.concat(F.lit("https://shop-"), F.col("o_custkey") % 7, F.lit(".example.com/products/pla-"), "o_orderkey").alias("url"),
    )
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_extendedprice")).cast("double")
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), "l_suppkey", "l_extendedprice", raw.alias("raw"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    sold = spread(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), line.alias("line")), "k", n=n)
    lines = sold.groupBy("k").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # a few lines an order
    return order.join(lines, "k", "left").withColumn("lines", F.coalesce("lines", F.array()))


@query(f"""WITH {SHOP}, offer AS (SELECT s.vendor, s.k, price FROM shop s JOIN priced p USING (k) WHERE tax <> 0.08 AND price < 10000),
steps AS (SELECT vendor, 'page_links:ok' AS action_status FROM shop UNION ALL
  SELECT vendor, 'fetch_product:' || CASE WHEN k IN (SELECT k FROM offer) THEN 'priced' ELSE 'no_price' END FROM shop)
SELECT 'log' AS tag, vendor, action_status AS what, count(*) AS n, CAST(0 AS DECIMAL(18, 4)) AS amount FROM steps GROUP BY ALL
UNION ALL SELECT 'candidate', vendor, 'links', count(*), 0 FROM shop WHERE k % 3 = 0 GROUP BY ALL
UNION ALL SELECT 'offer', vendor, 'shopify_variant_json', count(*), sum(CAST(price AS DECIMAL(18, 4))) FROM offer GROUP BY ALL""")
def page_harvest(spark, sf):
    """Candidates, offers and log of every order's page, from one scan of the pages: counts and sums of each."""
    found = harvested(spark, sf)
    zero = F.lit(0).cast("decimal(18,4)")
    parts = [
        found.log.groupBy("vendor", F.concat_ws(":", "action", "status").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.max(zero).alias("amount")).withColumn("tag", F.lit("log")),
        found.candidates.groupBy("vendor", F.lit("links").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.max(zero).alias("amount")).withColumn("tag", F.lit("candidate")),
        found.offers.groupBy("vendor", F.col("method").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,4)")).alias("amount")).withColumn("tag", F.lit("offer")),
    ]
    return K.union([p.select("tag", "vendor", "what", "n", F.col("amount").cast("decimal(18,4)").alias("amount")) for p in parts])


def harvested(spark, sf) -> H.Harvest:
    """The harvest of the shops' pages; every other page's title names a mass."""
    line = F.transform("lines", lambda x: F.struct(
        F.concat(F.lit("Variant "), x["no"]).alias("title"), F.concat(F.lit("S-"), x["part"]).alias("sku"), F.when(x["tax"] != 0.08, x["raw"]).alias("price"), (x["flag"] != "R").alias("available"),
    ))
    link = F.when(F.col("k") % 3 == 0, F.concat(F.lit('<a href="/products/petg-'), "k", F.lit('">PETG</a>'))).otherwise('<a href="/cart">Cart</a>')
    page = F.concat(F.lit("<title>PLA "), "k", F.when(F.col("k") % 2 == 0, " 500 g").otherwise(""), F.lit("</title>"), link, F.lit('<script>var p = {"variants": '), F.to_json(line), F.lit("};</script>"))
    pages = shop(spark, sf).select("url", page.alias("html"))
    return H.harvest(pages, F.regexp_extract("url", r"//([^.]*)\.", 1), F.lit(False))


@query(f"""WITH {SHOP}, offer AS (SELECT s.vendor, s.url, s.k, CAST(p.ord AS INT) AS ord, 'Variant ' || p.no AS variant, 'S-' || p.part AS sku, round(p.price, 4) AS price, CASE WHEN flag <> 'R' THEN 'InStock' ELSE 'OutOfStock' END AS availability
  FROM shop s JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS place FROM priced WHERE tax <> 0.08 AND price < 10000) p USING (k)),
once AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY url, price, variant, sku ORDER BY ord) = 1),
best AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY url, price, sku ORDER BY length(variant) DESC, ord) = 1),
mass AS (SELECT *, CAST(CASE WHEN k % 2 = 0 THEN 0.5 END AS DOUBLE) AS mass_kg, CASE vendor WHEN 'shop-1' THEN 'EUR' WHEN 'shop-2' THEN 'USD' ELSE '' END AS currency FROM best)
SELECT vendor, url, variant, sku, price, currency, mass_kg, CASE WHEN mass_kg IS NULL THEN '' ELSE 'product:500 g' END AS mass_source, round(price / mass_kg, 4) AS price_per_kg,
  round(price * CASE currency WHEN 'EUR' THEN 2.0::DOUBLE WHEN 'USD' THEN 1.0::DOUBLE END, 4) AS price_usd, availability FROM mass""")
def price_run(spark, sf):
    """From pages to price rows: offers deduplicated a page, masses from titles, prices a kilogram and in dollars."""
    rates = spark.createDataFrame([("EUR", 2.0), ("USD", 1.0)], "currency string, rate double")
    own = F.when(F.col("vendor") == "shop-1", "EUR").when(F.col("vendor") == "shop-2", "USD").otherwise("")
    made = H.price_rows(harvested(spark, sf), rates, own)
    return made.select("vendor", "url", "variant", "sku", "price", "currency", "mass_kg", "mass_source", "price_per_kg", "price_usd", "availability")


@query(f"""WITH {SHOP}, told AS (
  SELECT s.vendor, s.url, s.k, p.ord, p.part, p.flag, p.price,
    CASE p.no % 3 WHEN 1 THEN 'Spool 1kg' WHEN 0 THEN 'PLA 750 g' ELSE 'Default' END AS variant,
    CAST(CASE p.no % 3 WHEN 1 THEN 1 WHEN 0 THEN 0.75 ELSE CASE WHEN s.k % 2 = 0 THEN 3 END END AS DOUBLE) AS mass_kg
  FROM shop s JOIN priced p USING (k) WHERE tax <> 0.08 AND s.k % 11 <> 0 AND s.k % 13 <> 0 AND s.k % 17 <> 0 AND price > 0 AND price < 10000)
SELECT vendor, 'Order ' || k AS product, variant, 'S-' || part AS sku, url, CAST(ord AS INT) AS ord, round(price, 4) AS price, CASE vendor WHEN 'shop-1' THEN 'EUR' WHEN 'shop-2' THEN 'USD' ELSE '' END AS currency,
  mass_kg, CASE variant WHEN 'Spool 1kg' THEN 'variant:1kg' WHEN 'PLA 750 g' THEN 'variant:750 g' ELSE CASE WHEN mass_kg IS NULL THEN '' ELSE 'labeled_page_text:3 kg' END END AS mass_source,
  round(price / mass_kg, 4) AS price_per_kg, CASE WHEN flag <> 'R' THEN 'InStock' ELSE 'OutOfStock' END AS availability, 'shopify_product_js' AS price_source, 'sitemap' AS candidate_source FROM told""")
def product_json_rows(spark, sf):
    """Priced variants of every order's product document; some documents are broken, of another type, or without a list."""
    line = F.transform("lines", lambda x: F.struct(
        F.when(x["tax"] != 0.08, x["raw"]).alias("price"), F.when(x["no"] % 3 == 1, "Spool 1kg").alias("name"), F.when(x["no"] % 3 == 0, "PLA 750 g").otherwise("").alias("public_title"),
        F.lit("Default").alias("title"), F.concat(F.lit("S-"), x["part"]).alias("sku"), (x["flag"] != "R").alias("available"),
    ))
    k = F.col("k")
    about = F.when(k % 2 == 0, "<p>Net weight: 3 kg</p><p>Shipping weight: 5 kg</p>").otherwise("")
    doc = F.concat(F.lit('{"title": "Order '), k, F.lit('", "description": "'), about, F.lit('", "variants": '), F.when(k % 17 == 0, '{"price": 3}').otherwise(F.to_json(line)), F.when(k % 11 == 0, "").otherwise("}"))
    kind = F.when(k % 13 == 0, "text/html").when(k % 2 == 0, "text/javascript; charset=utf-8").otherwise("Application/JSON")
    fetched = shop(spark, sf).select("vendor", F.concat("url", F.lit("?ref=x")).alias("url"), F.lit("hint").alias("hint"), F.lit("sitemap").alias("source"), kind.alias("content_type"), doc.alias("body"))
    return J.product_rows(fetched, {"shop-1": "EUR", "shop-2": "USD"})


#: Batches of the growing rollup; every row comes in two of them.
SLICES = 4


@query(f"""WITH {OFFERS}, fx(currency, rate) AS (VALUES ('EUR', 1.25), ('GBP', 1.5), ('USD', 1.0))
SELECT vendor, count(*) AS price_rows, count(mass_kg) AS with_mass, count(mass_kg) AS with_price_per_kg, count(rate) AS with_usd, count(DISTINCT url) AS priced_urls, count(DISTINCT product) AS priced_products,
  string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies FROM offers LEFT JOIN fx USING (currency) GROUP BY 1""")
def growing_rollup(spark, sf):
    """The vendors' rollup after several overlapping batches, from partials alone."""
    rates = spark.createDataFrame(RATES, "currency string, rate double")
    rows = add_usd(offers(spark, sf).withColumn("sku", F.lit("")), rates).withColumn("ord", F.col("url"))
    path = folder(spark)
    for k in range(SLICES):
        own = F.pmod("url", F.lit(SLICES)).isin(k, (k + 1) % SLICES)
        O.fold(rows.where(own), k, path, filament_only=False)
    return O.rollup(spark, path)
