"""Queries over texts, urls, profiles, geometry; the rest of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..functions import units as U
from ..operators import beam as B
from ..operators import query as Q
from ..scratch import spread
from .catalog import OBS, query, table

LINES = r"""lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(line) <> '')"""


def lines(spark, sf):
    """Non-empty lines of documents, numbered: arrays, so nothing is shuffled."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(kept).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(f"""WITH {LINES} SELECT doc_id, line_no, md5(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), ' | ')) AS window_md5 FROM lines""")
def context_windows(spark, sf):
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    framed = table(spark, sf, "documents").select("doc_id", kept.alias("lines"))
    frames = F.transform("lines", lambda _, i: F.md5(F.array_join(F.slice("lines", i + 1, 6), " | ").cast("binary")))
    return framed.select("doc_id", F.posexplode(frames).alias("i", "window_md5")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "window_md5")


@query("""SELECT doc_id, count(*) AS cells, max(strlen(cell)) AS longest FROM (SELECT doc_id, replace(unnest(string_split(text, '|')), ' ', '') AS cell FROM documents) WHERE cell <> '' GROUP BY 1""")
def cell_explode(spark, sf):
    cells = F.filter(F.split(F.replace("text", F.lit(" "), F.lit("")), r"\|"), lambda x: x != "")
    rows = table(spark, sf, "documents").select("doc_id", F.explode(cells).alias("cell"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.max(F.octet_length("cell")).cast("long").alias("longest"))


@query(f"""WITH {LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z]') THEN line_no END AS label_at FROM lines)
SELECT doc_id, line_no, last_value(label_at IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label_at FROM h""")
def nearest_label(spark, sf):
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    label = F.when(F.col("line").rlike("^[A-Z]"), F.col("line_no"))
    return lines(spark, sf).select("doc_id", "line_no", F.last(label, ignorenulls=True).over(w).alias("label_at"))


@query(r"""SELECT doc_id, len(n) AS numbers, coalesce(array_to_string(n[1:5], ';'), '') AS first_numbers
FROM (SELECT doc_id, regexp_extract_all(text, '[-+]?[0-9]+(?:[.,][0-9]+)?') AS n FROM documents)""")
def number_scan(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"[-+]?[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.size(found).cast("long").alias("numbers"), F.array_join(F.slice(found, 1, 5), ";").alias("first_numbers"))


#: Forms of a raw value, filled with each part's size (1 to 50) and its key's last digits.
RAWS = ["{a}.5", "<{a}", "{a}-{b}", "{a} +/- 0.{b}", "{b} to {a}", "about", "{a},{b}", ">{a} - {b}"]
_RAWS = "[" + ", ".join("replace(replace('" + r + "', '{a}', p_size::VARCHAR), '{b}', (p_partkey % 97)::VARCHAR)" for r in RAWS) + "]"


@query(f"""WITH r AS (SELECT p_partkey, {_RAWS}[p_partkey % 8 + 1] AS raw FROM part),
x AS (SELECT *, replace(raw, ',', '.') AS t FROM r),
g AS (SELECT *, regexp_extract(t, '([<>~])?\\s*([-+]?\\d+(?:[.,]\\d+)?)(?:\\s*(?:±|\\+/-)\\s*([-+]?\\d+(?:[.,]\\d+)?))?(?:\\s*(?:-|to|–)\\s*([-+]?\\d+(?:[.,]\\d+)?))?', ['s', 'a', 'pm', 'b']) AS m FROM x),
n AS (SELECT *, try_cast(nullif(m.a, '') AS DOUBLE) AS a, try_cast(nullif(m.pm, '') AS DOUBLE) AS pm, try_cast(nullif(m.b, '') AS DOUBLE) AS b FROM g),
l AS (SELECT *, CASE WHEN pm IS NOT NULL THEN a - pm WHEN b IS NOT NULL THEN least(a, b) ELSE a END AS lo,
  CASE WHEN pm IS NOT NULL THEN a + pm WHEN b IS NOT NULL THEN greatest(a, b) ELSE a END AS hi FROM n)
SELECT p_partkey, raw, round(lo * 1000, 6) AS lo, round(hi * 1000, 6) AS hi, round(CASE WHEN pm IS NULL AND b IS NOT NULL THEN (lo + hi) / 2 ELSE a END * 1000, 6) AS nominal,
 CASE WHEN a IS NULL THEN 'non_numeric' ELSE concat_ws(';', CASE WHEN m.s <> '' THEN 'inequality:' || m.s END, 'unit_converted:GPa->MPa') END AS flags FROM l""")
def parse_numeric(spark, sf):
    form = F.element_at(F.array(*[F.lit(r) for r in RAWS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    raw = F.replace(F.replace(form, F.lit("{a}"), F.col("p_size").cast("string")), F.lit("{b}"), (F.col("p_partkey") % 97).cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    v = U.parse_numeric(F.col("raw"), F.lit("GPa"), F.lit("MPa"))
    made = rows.withColumn("v", v)
    return made.select("p_partkey", "raw", *[F.round(f"v.{c}", 6).alias(c) for c in ("lo", "hi", "nominal")], F.col("v.flags").alias("flags"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS v, ['degF', 'GPa', 'psi', 'kg/m3', 'g', 'mm'][l_linenumber % 6 + 1] AS unit_raw,
 ['degC', 'MPa', 'MPa', 'g/cm3', 'kg', 'm'][l_linenumber % 6 + 1] AS unit_canonical FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unit_raw, unit_canonical, round(CASE unit_raw WHEN 'degF' THEN (v - 32) * 5 / 9 WHEN 'GPa' THEN v * 1000 WHEN 'psi' THEN v * 0.006894757::DOUBLE
 WHEN 'kg/m3' THEN v * 0.001::DOUBLE WHEN 'g' THEN v * 0.001::DOUBLE END, 6) AS value FROM u""")
def unit_convert(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("v"),
        pick(["degF", "GPa", "psi", "kg/m3", "g", "mm"]).alias("unit_raw"), pick(["degC", "MPa", "MPa", "g/cm3", "kg", "m"]).alias("unit_canonical"),
    )
    return rows.withColumn("value", F.round(U.convert(F.col("v"), F.col("unit_raw"), F.col("unit_canonical")), 6)).drop("v")


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '®', ''), '±', '+/-'), '–', '-'), '℃', '°C'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x{00a0}\\x{2000}-\\x{200a}]+', ' ', 'g'))) AS clean_md5 FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.compact_spaces(F.col("text")).cast("binary")).alias("clean_md5"))


URL_RE = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '{URL_RE}', ['scheme', 'host', 'path', 'query', 'fragment']) AS m FROM pages)
SELECT page_id, m.host AS host, m.path AS path, m.query AS query, m.scheme || '://' || m.host || coalesce(nullif(regexp_replace(m.path, '/+$', ''), ''), '/') AS price_url,
 m.scheme || '://' || m.host || m.path || CASE WHEN m.query <> '' THEN '?' || m.query ELSE '' END AS page_url FROM u""")
def url_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", X.url_part(url, "host").alias("host"), X.url_part(url, "path").alias("path"), X.url_part(url, "query").alias("query"),
        X.normalize_price_url(url).alias("price_url"), X.normalize_page_url(url).alias("page_url"),
    )


def _unescaped(sql: str, end: str = ";?") -> str:
    """SQL for the text of HTML: entities that these pages hold, and white space. In text HTML reads these names without their semicolon, too."""
    for entity, sign in ((f"&lt{end}", "<"), (f"&gt{end}", ">"), (f"&quot{end}", '"'), ("&#x27;", "''"), (f"&amp{end}", "&")):
        sql = f"regexp_replace({sql}, '{entity}', '{sign}', 'g')"
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT url, {_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_unescaped("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
  replace(regexp_replace(regexp_extract(url, '^[^?#]*?([^/?#]*)(?:[?#].*)?$', 1), '\\.[^.]*$', ''), '-', ' ') AS slug, html FROM pages),
s AS (SELECT *, list_filter([heading, title, slug], lambda x: x <> '') AS every FROM p),
m AS (SELECT *, list_transform(every, lambda x: {{'s': length(x) + CASE WHEN regexp_matches(lower(x), '\\b(kg|g|lb|lbs)\\b') THEN 100 ELSE 0 END + CASE WHEN contains(lower(x), 'filament') THEN 50 ELSE 0 END, 't': x}}) AS scored FROM s)
SELECT url, coalesce(list_sort(scored)[-1].t, '') AS best_title, trim(regexp_replace(coalesce(nullif(heading, ''), nullif(title, ''), slug), '(?i)\\s*[|-]\\s*(SUNLU|ELEGOO|Anycubic|HATCHBOX|Creality Store|ColorFabb|Fillamentum).*$', '')) AS first_title,
 len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS links, len(regexp_extract_all(html, '(?i)<tr\\b')) AS table_rows FROM m""")
def page_structure(spark, sf):
    from ..sources.html import best_title, first_title, parse_pages

    pages = parse_pages(table(spark, sf, "pages").select("url", "html"))
    return pages.select("url", best_title(F.col("url")).alias("best_title"), first_title(F.col("url")).alias("first_title"), F.size("links").cast("long").alias("links"), F.size("rows").cast("long").alias("table_rows"))


@query(f"""WITH a AS (SELECT url, html, regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a [^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS texts FROM pages),
l AS (SELECT url, unnest(range(len(hrefs))) AS ord, unnest(hrefs) AS href, unnest(texts) AS text FROM a)
SELECT url, ord, regexp_extract(url, '^[^:]*://[^/?#]*') || {_unescaped("href", ";")} AS link, {_unescaped("text")} AS text FROM l WHERE href LIKE '/%'""")
def link_explode(spark, sf):
    from ..sources.html import page_links, parse_pages

    return page_links(parse_pages(table(spark, sf, "pages").select("url", "html"))).select("url", F.col("ord").cast("long").alias("ord"), "link", "text")


@query()
def page_offers(spark, sf):
    """Offers and specification rows of pages; these pages carry few, fixtures in the tests carry all kinds."""
    from ..sources.html import page_offers as offers
    from ..sources.html import parse_pages

    return offers(parse_pages(table(spark, sf, "pages").select("url", "html")), F.lit(True)).select("url", "price", "currency", "method")


@query("""SELECT p_partkey, label, CASE WHEN regexp_matches(label, 'price|color') THEN NULL WHEN regexp_matches(label, 'diameter tolerance|\\btolerance\\b') THEN 'Diameter Tolerance'
 WHEN regexp_matches(label, '\\bdiameter\\b') THEN 'Diameter' WHEN regexp_matches(label, 'tensile strength|tensile stress') THEN 'Tensile Strength' WHEN regexp_matches(label, '\\bhdt\\b') THEN 'Heat Distortion Temperature'
 WHEN regexp_matches(label, '\\bdensity\\b') THEN 'Density' END AS canonical
FROM (SELECT p_partkey, ['diameter (mm)', 'diameter tolerance', 'tensile stress at yield', 'hdt at 0.45 mpa', 'color price', 'density', 'unknown thing'][p_partkey % 7 + 1] AS label FROM part)""")
def canonical_label(spark, sf):
    labels = ["diameter (mm)", "diameter tolerance", "tensile stress at yield", "hdt at 0.45 mpa", "color price", "density", "unknown thing"]
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("label"))
    return rows.withColumn("canonical", C.canonical_label(F.col("label")))


#: Pieces that product names and test texts are put together from, by each part's key and size.
LEADS = ["PolyMax ", "", "colorFabb_", "Easy™ ", "Ultra "]
BASES = ["PLA", "PA6-CF", "PETG", "ULTEM 9085", "XT", "TPU 95A", "PC-ABS", "ABS", "mystery", "Nylon", "PPS-CF", "HT", "PC ABS", "XT-CF20", "ASA", "PCTG", "PP"]
TAILS = ["", " Basic", " Matte Black", " Flex", " FR", " Carbon Fiber", " GF20", " Silk Glow", " Stonefill", " Pro High Speed", " Max", " Wood Recycled", " Glass"]
#: Fixed values, as the check states them: tokens in their order, and words with what they stand for.
_TOKENS = """['PLA-CF', 'PETG-CF', 'PA6-CF', 'PA12-CF', 'PA612-CF', 'PC-ABS', 'PC ABS', 'PCASA', 'PC-ASA', 'ABS-GF', 'ASA-CF', 'PET-CF', 'PPA-CF', 'PPS-CF', 'TPU', 'PETG', 'PCTG', 'PLA', 'ABS', 'ASA', 'HIPS', 'PAHT',
 'PA6', 'PA12', 'PA11', 'NYLON', 'PA', 'PC', 'PEEK', 'PEKK', 'PEI', 'ULTEM', 'PPSU', 'PPS', 'PSU', 'PVDF', 'PVA', 'PVB', 'PHA', 'PP', 'CPE']"""
_WORDS = """['MATTE:Matte', 'BASIC:Basic', 'SILK:Silk', 'WOOD:Wood', 'STONEFILL:Stone', 'BRONZEFILL:Metal', 'COPPERFILL:Metal', 'STEELFILL:Metal', 'LIGHT WEIGHT:Lightweight', 'CF:Carbon fiber', 'CARBON:Carbon fiber',
 'GF:Glass fiber', 'GLASS:Glass fiber', 'ESD:ESD', 'AERO:Aero', 'GLOW:Glow', 'MARBLE:Marble', 'METAL:Metal', 'RECYCLED:Recycled', 'TOUGH:Tough', 'HIGH SPEED:High speed', 'HS:High speed', 'PRO:Pro', 'MAX:Max',
 'FLEX:Flexible', 'SUPPORT:Support', 'TRANSLUCENT:Translucent', 'TRANSPARENT:Transparent', 'FIRE:Flame retardant', 'FR:Flame retardant']"""


def _picked(values: list[str], of: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{of} % {len(values)} + 1]"


def picked(values: list[str], of: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values) + 1).cast("int"))


@query(f"""WITH n AS (SELECT p_partkey, {_picked(LEADS, 'p_partkey')} || {_picked(BASES, 'p_size')} || {_picked(TAILS, '(p_partkey // 7)')} || ' ' || p_size AS product FROM part),
u AS (SELECT *, upper(replace(replace(product, '™', ''), '®', '')) AS up FROM n),
h AS (SELECT *, list_filter({_TOKENS}, lambda t: contains(up, t))[1] AS hit,
  list_transform(list_filter({_WORDS}, lambda w: contains(up, split_part(w, ':', 1))), lambda w: split_part(w, ':', 2)) AS every FROM u),
g AS (SELECT *, CASE WHEN hit = 'NYLON' THEN 'PA' ELSE coalesce(hit, 'Unknown') END AS fam, list_filter(every, lambda t, i: list_position(every, t) = i) AS tags FROM h),
m AS (SELECT *, list_reduce(list_filter(tags, lambda t: t NOT IN ('Stone', 'Lightweight', 'Max')), lambda f, t: CASE WHEN contains(upper(f), upper(t)) OR (t = 'Carbon fiber' AND regexp_matches(f, 'CF|CARBON'))
  OR (t = 'Glass fiber' AND regexp_matches(f, 'GF|GLASS')) THEN f ELSE f || ' ' || t END, fam) AS told FROM g)
SELECT p_partkey, product,
  CASE WHEN regexp_matches(up, 'COLORFABB[_ ](XT|HT)|XT[- ]CF20') THEN 'CPE' WHEN fam IN ('PCASA', 'PC ABS') THEN 'PC' WHEN fam = 'ULTEM' THEN 'PEI' ELSE split_part(fam, '-', 1) END AS base,
  CASE WHEN regexp_matches(up, 'COLORFABB[_ ]XT') THEN 'colorFabb_XT' WHEN regexp_matches(up, 'COLORFABB[_ ]HT') THEN 'colorFabb_HT' WHEN regexp_matches(up, 'XT[- ]CF20') THEN 'XT-CF20' ELSE told END AS family,
  CASE WHEN regexp_matches(up, 'COLORFABB[_ ](XT|HT)') THEN '' WHEN regexp_matches(up, 'XT[- ]CF20') THEN 'Carbon fiber' ELSE array_to_string(tags, ',') END AS modifiers FROM m""")
def classify_material(spark, sf):
    """Classes of names put together from leads, bases and tails."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(picked(LEADS, k), picked(BASES, size), picked(TAILS, F.floor(k / 7)), F.lit(" "), size)
    made = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", name.alias("product")).withColumn("c", C.classify_material(F.col("product")))
    return made.select("p_partkey", "product", F.col("c.base").alias("base"), F.col("c.family").alias("family"), F.array_join("c.modifiers", ",").alias("modifiers"))


WORDS = ["dry", "notched", "Unnotched", "Annealed", "dried at 60", "conditioned", "yield", "break", "wet", "X-Y", "xy plane", "Z", "YZ", "flat", "on its side", "vertical", "Horizontal", "standing up", "upper", "0.45 MPa", "1,8 MPa", "nothing"]


@query(f"""WITH t AS (SELECT p_partkey, {_picked(WORDS, 'p_partkey')} || ', ' || {_picked(WORDS, '(p_partkey // 22 + 3)')} || ' / ' || {_picked(WORDS, '(p_size * 5)')} AS t FROM part),
l AS (SELECT *, lower(t) AS low, upper(t) AS up FROM t)
SELECT p_partkey, t, coalesce(list_filter(['X-Y', 'XY', 'YZ', 'Z', 'HORIZONTAL', 'VERTICAL'], lambda w: regexp_matches(up, '\\b' || w || '\\b'))[1],
  CASE WHEN contains(up, 'FLAT') THEN 'flat' WHEN contains(up, 'SIDE') THEN 'side' WHEN regexp_matches(up, '\\bUP\\b') THEN 'up' END) AS orientation,
  nullif(array_to_string(list_concat(list_filter(['dry', 'wet', 'annealed', 'dried', 'conditioned', 'unnotched', 'notched', 'yield', 'break'], lambda w: regexp_matches(low, '\\b' || w || '\\b')),
    list_filter([CASE WHEN regexp_matches(low, '0[.,]45') THEN '0.45 MPa load' END, CASE WHEN regexp_matches(low, '1[.,]8') THEN '1.8 MPa load' END], lambda x: x IS NOT NULL)), ', '), '') AS condition FROM l""")
def condition_tags(spark, sf):
    """Orientation and condition of texts put together from three pieces."""
    k = F.col("p_partkey")
    text = F.concat(picked(WORDS, k), F.lit(", "), picked(WORDS, F.floor(k / 22) + 3), F.lit(" / "), picked(WORDS, F.col("p_size") * 5))
    rows = table(spark, sf, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", "t", C.orientation(F.col("t")).alias("orientation"), C.condition(F.col("t")).alias("condition"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(['returned:' || l_returnflag, CASE WHEN l_linestatus = 'F' THEN 'closed' END, CASE WHEN l_discount > 0.05 THEN 'unit_converted:psi->MPa' END], lambda x: x IS NOT NULL), ';') AS flags,
 l_discount > 0.05 AS converted FROM lineitem""")
def flag_set(spark, sf):
    first = F.concat(F.lit("returned:"), "l_returnflag")
    flags = X.append_flag(X.append_flag(first, F.when(F.col("l_linestatus") == "F", "closed")), F.when(F.col("l_discount") > 0.05, "unit_converted:psi->MPa"))
    converted = F.exists(X.flag_list(F.col("flags")), lambda f: f.startswith("unit_converted:"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flags.alias("flags")).withColumn("converted", converted)


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_profile(spark, sf):
    v = F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')")
    return table(spark, sf, "events").select("event_id", v.alias("k")).where("k IS NOT NULL")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 OR o_totalprice > 200 THEN o_totalprice / 100 ELSE o_totalprice END AS price,
 CASE WHEN o_totalprice > 0 AND o_totalprice < 10000 THEN o_totalprice END AS number FROM orders""")
def price_heuristics(spark, sf):
    price = U.shop_price(F.col("o_totalprice"), F.col("o_orderkey") % 10 == 0)
    number = U.number_or_none(F.col("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", price.alias("price"), number.alias("number"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey % 900 + 1 AS g, o_orderkey % 40 AS r FROM orders), m AS (SELECT *,
  CASE o_orderkey % 6 WHEN 0 THEN 'PLA 1.75mm ' || g || 'g spool' WHEN 1 THEN r || ' x ' || g || ' g pack' WHEN 2 THEN r || '.5 lb roll' WHEN 3 THEN 'MOQ ' || r || 'kg only' WHEN 4 THEN 'spool of ' || r || ',25 kg, box of ' || g || ' grams' ELSE 'no mass ' || g END AS t,
  CASE o_orderkey % 6 WHEN 0 THEN [g / 1000.0::DOUBLE] WHEN 1 THEN [r * g / 1000.0::DOUBLE, g / 1000.0::DOUBLE] WHEN 2 THEN [(r + 0.5::DOUBLE) * 0.45359237] WHEN 4 THEN [r + 0.25::DOUBLE, g / 1000.0::DOUBLE] ELSE [] END AS kgs FROM n)
SELECT o_orderkey, t, round(list_max(list_filter(kgs, lambda x: x BETWEEN 0.05 AND 25)), 6) AS kg FROM m""")
def mass_candidates(spark, sf):
    """The largest plausible mass of texts made of every order's numbers: single masses, packs, pounds, minimum orders, several masses."""
    k, g, r = F.col("o_orderkey"), F.col("o_custkey") % 900 + 1, F.col("o_orderkey") % 40
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("PLA 1.75mm "), g, F.lit("g spool"))).when(k % 6 == 1, F.concat(r, F.lit(" x "), g, F.lit(" g pack")))
        .when(k % 6 == 2, F.concat(r, F.lit(".5 lb roll"))).when(k % 6 == 3, F.concat(F.lit("MOQ "), r, F.lit("kg only")))
        .when(k % 6 == 4, F.concat(F.lit("spool of "), r, F.lit(",25 kg, box of "), g, F.lit(" grams"))).otherwise(F.concat(F.lit("no mass "), g))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return rows.withColumn("kg", F.round(U.largest_mass(F.col("t"))["kg"], 6))


@query("""SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next_role FROM conversations""")
def next_line_lookahead(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"))


EDGES = [("notched", *map(float, (*a, *b))) for p in [B.PRESETS["notched"]["points"]] for a, b in zip(p, p[1:] + p[:1])]


@query(
    "WITH e(model, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, c, d in EDGES)
    + """), c AS (SELECT DISTINCT l_quantity * 3.1::DOUBLE AS x FROM lineitem), h AS (SELECT x, y1 + (x - x1) / (x2 - x1) * (y2 - y1) AS y FROM c JOIN e ON x >= least(x1, x2) AND x < greatest(x1, x2) AND abs(x2 - x1) >= 1e-9),
p AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY y) AS k FROM h), i AS (SELECT a.x, a.y AS a, b.y AS b FROM p a JOIN p b ON a.x = b.x AND a.k % 2 = 1 AND b.k = a.k + 1)
SELECT round(x, 6) AS x, round(sum(b - a), 6) AS total, round(sum((a + b) / 2 * (b - a)) / sum(b - a), 6) AS center FROM i GROUP BY x"""
)
def polygon_sections(spark, sf):
    edges = spark.createDataFrame(EDGES, "model string, x1 double, y1 double, x2 double, y2 double")
    cuts = table(spark, sf, "lineitem").select(F.lit("notched").alias("model"), (F.col("l_quantity") * 3.1).alias("x")).distinct()
    return B.cross_sections(edges, cuts).select(*[F.round(c, 6).alias(c) for c in ("x", "total", "center")])


@query("""WITH el AS (SELECT range AS el, range * 1.5::DOUBLE AS a, (range + 1) * 1.5::DOUBLE AS b FROM range(100)), l AS (SELECT DISTINCT l_quantity AS x2, l_quantity / 2 AS x1 FROM lineitem)
SELECT el, x2 AS id, least(b, x2) - greatest(a, x1) AS overlap FROM el JOIN l ON greatest(a, x1) < least(b, x2)""")
def interval_overlap(spark, sf):
    el = spark.range(100).select(F.lit("m").alias("model"), F.col("id").alias("el"), (F.col("id") * 1.5).alias("a"), ((F.col("id") + 1) * 1.5).alias("b"))
    loads = table(spark, sf, "lineitem").select("l_quantity").distinct().select(F.lit("m").alias("model"), F.col("l_quantity").alias("id"), (F.col("l_quantity") / 2).alias("x1"), F.col("l_quantity").alias("x2"))
    return B.overlaps(el, loads).select("el", "id", "overlap")


@query("""WITH n AS (SELECT range AS idx, range * 1.5::DOUBLE AS node_x FROM range(40)), p AS (SELECT DISTINCT l_quantity AS x FROM lineitem)
SELECT x, idx FROM (SELECT x, idx, row_number() OVER (PARTITION BY x ORDER BY abs(node_x - x), idx) AS k FROM p, n) WHERE k = 1""")
def nearest_node(spark, sf):
    nodes = spark.range(40).select(F.lit("m").alias("model"), F.col("id").alias("idx"), (F.col("id") * 1.5).alias("node_x"))
    points = table(spark, sf, "lineitem").select("l_quantity").distinct().select(F.lit("m").alias("model"), F.col("l_quantity").alias("id"), F.col("l_quantity").alias("x"))
    return B.nearest(points, nodes).select("x", "idx")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS here, lag(l_quantity) OVER w AS before, lead(l_quantity) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 + least(1.4, 3.2 * abs(coalesce(after, here) - coalesce(before, here)) / 20 + CASE WHEN abs(coalesce(after, here) - here) > 0.22 * here THEN 0.35 ELSE 0 END), 6) AS kt FROM h""")
def stress_concentration(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    here = F.col("l_quantity")
    before, after = F.coalesce(F.lag(here).over(w), here), F.coalesce(F.lead(here).over(w), here)
    jump = F.when(F.abs(after - here) > 0.22 * here, 0.35).otherwise(0.0)
    kt = 1 + F.least(F.lit(1.4), 3.2 * F.abs(after - before) / 20 + jump)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(kt, 6).alias("kt"))


@query()
def beam_scenarios(spark, sf):
    made = B.summary(B.stations(B.matrix(B.preset_models(spark), e=2400 / 0.75, strength=58.0)))
    return made.select("model", "scenario", "direction", *[F.round(c, 6).alias(c) for c in ("max_deflection", "max_stress", "max_moment", "max_shear", "max_util")], "risk")


@query()
def beam_stations(spark, sf):
    made = B.stations(B.matrix(B.preset_models(spark)))
    return made.select("model", "scenario", "direction", "station", *[F.round(c, 6).alias(c) for c in ("x", "deflection", "moment", "stress", "util", "height", "y_center", "kt")])


@query("""SELECT p_partkey, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296)::BIGINT AS hash FROM part""")
def color_hash(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.polynomial_hash(F.col("p_name")).alias("hash"))


@query("""SELECT DISTINCT l_quantity AS v, floor(l_quantity / 5 + 0.5) * 5 AS snapped, CASE WHEN l_quantity / 50 >= 1 THEN 'fail' WHEN l_quantity / 50 >= 0.65 THEN 'watch' ELSE 'safe' END AS risk FROM lineitem""")
def snap_and_risk(spark, sf):
    v = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(v.alias("v"), B.snap(v, 5.0).cast("double").alias("snapped"), B.risk(v / 50).alias("risk")).distinct()


@query("""WITH o(property_key, k, unit_raw, test_method, quality_flag) AS (VALUES ('density', 0, 'g/cm3', 'ISO 1183', NULL), ('tensile_strength', 1, 'MPa', 'ISO 527', NULL),
 ('nozzle_temperature', 2, 'degC', NULL, NULL), ('impact_izod', 3, 'ft-lb/in', 'ASTM D256', 'unit_converted:ft-lb/in->J/m')),
r AS (SELECT p_partkey::VARCHAR AS material_id, o.*, CASE k WHEN 0 THEN round(1 + p_size / 100.0::DOUBLE, 2)::VARCHAR WHEN 1 THEN (20 + p_size)::VARCHAR WHEN 2 THEN (190 + p_size)::VARCHAR ELSE round(p_size / 10.0::DOUBLE, 1)::VARCHAR END AS raw_value FROM part CROSS JOIN o)
SELECT material_id, property_key, raw_value, unit_raw, round(raw_value::DOUBLE * CASE WHEN k = 3 THEN 1.3558179483314004::DOUBLE / 0.0254 ELSE 1 END, 6) AS value_nominal, test_method, quality_flag FROM r""")
def extraction(spark, sf):
    """Observations of lines that read like datasheet rows, made from part's numbers."""
    from ..operators.extract import extract

    row = lambda label, value, unit, method: F.concat(F.lit(f"{label} | "), value.cast("string"), F.lit(f" {unit} | {method}"))
    size = F.col("p_size")
    rows = F.array(
        row("Density", F.round(1 + size / 100.0, 2), "g/cm3", "ISO 1183"), row("Tensile strength", 20 + size, "MPa", "ISO 527"), row("Nozzle temperature", 190 + size, "°C", "recommended"),
        row("Notched Izod Impact", F.round(size / 10.0, 1), "ft-lb/in", "ASTM D256"),
    )
    parts = spread(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("material_id"), "p_size"), "material_id")
    docs = parts.select("material_id", F.lit("").alias("text"), rows.alias("rows"))
    return extract(docs)[0].select("material_id", "property_key", "raw_value", "unit_raw", F.round("value_nominal", 6).alias("value_nominal"), "test_method", "quality_flag")


def detection_rows(spark, sf):
    """Observations with planted faults, made from part's numbers."""
    size = F.col("p_size")
    key = F.element_at(F.array(*[F.lit(k) for k in ("density", "vicat", "chamber_temperature", "tensile_modulus", "elongation")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    raw = F.element_at(F.array(F.lit("60"), F.lit("306"), size.cast("string"), size.cast("string"), F.lit("150")), (F.col("p_partkey") % 5 + 1).cast("int"))
    ctx = F.element_at(F.array(*[F.lit(t) for t in ("Infill density | 60 %", "Vicat | ISO 306 | 306", "Chamber temperature | note", "Tensile modulus | MPa", "Elongation | 150 %")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("material_id"), F.col("p_brand").alias("supplier"), F.col("p_name").alias("product"), F.col("p_type").alias("base_material"), F.col("p_type").alias("material_family"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("source_file"), key.alias("property_key"), key.alias("property_label"), key.alias("raw_label"), raw.alias("raw_value"),
        raw.cast("double").alias("value_nominal"), F.lit("").alias("unit_raw"), F.lit("MPa").alias("unit_canonical"), F.lit("").alias("test_method"), F.lit("").alias("orientation"), F.lit("").alias("condition"),
        ctx.alias("source_context"), F.lit("").alias("quality_flag"),
    )


FAULTS = """CASE p_partkey % 5 WHEN 0 THEN 'infill_density_captured_as_material_density' WHEN 1 THEN 'vicat_method_and_load_captured_as_temperature'
  WHEN 2 THEN CASE WHEN p_size < 20 THEN 'chamber_temperature_captured_from_note_number' END WHEN 3 THEN CASE WHEN p_size < 100 THEN 'very_low_modulus_outlier_for_rigid_material' END
  ELSE 'high_elongation_outlier_for_rigid_material' END"""


@query(f"""SELECT * FROM (SELECT p_partkey AS material_id, {FAULTS} AS issue_type FROM part WHERE NOT regexp_matches(p_brand || ' ' || p_name || ' ' || p_type, '(?i)\\b(TPU|TPE|PEBA|flex)')) WHERE issue_type IS NOT NULL""")
def issue_detection(spark, sf):
    from ..operators.issues import detect

    return detect(detection_rows(spark, sf)).select("material_id", "issue_type")


@query("""SELECT p_partkey AS material_id, 'outside_strict_range' AS kind FROM part WHERE p_partkey % 5 = 0 AND NOT regexp_matches(p_brand || ' ' || p_name || ' ' || p_type, '(?i)bronze|copper|iron|magnetic|magnetite|metal|steel|tungsten')""")
def strict_audit(spark, sf):
    from ..operators.audit import observed

    rows = detection_rows(spark, sf).where("property_key = 'density'")
    return observed(rows).where("kind = 'outside_strict_range'").select(F.substring("source_file", 2, 20).cast("long").alias("material_id"), "kind")


@query(f"""WITH {OBS} SELECT material_id, property_key || CASE WHEN orientation = 'F' THEN '::xy' ELSE '::z' END AS option_key, count(*) AS n FROM obs WHERE property_key IN ('quantity', 'tax') GROUP BY 1, 2""")
def scoped_options(spark, sf):
    from .catalog import observations

    side = Q.orientation_bucket(F.when(F.col("orientation") == "F", "XY").otherwise("Z"))
    scope = spark.createDataFrame([("quantity",), ("tax",)], "property_key string")
    rows = observations(spark, sf).join(scope, "property_key", "left_semi")
    return rows.groupBy("material_id", F.concat_ws("::", "property_key", side).alias("option_key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf):
    from ..streaming.ingest import windowed_counts as counts

    return counts(table(spark, sf, "events"))


#: DuckDB's printf sends exact ties to the even digit; a little more sends them up, as the display does.
SHOWN_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN p >= 1000 THEN printf('%.0f', CASE WHEN p * 2 = floor(p * 2) AND (p * 2)::BIGINT % 2 = 1 THEN p + 0.25 ELSE p END)
  WHEN p >= 100 THEN printf('%.1f', CASE WHEN p * 4 = floor(p * 4) AND (p * 4)::BIGINT % 2 = 1 THEN p + 0.0625 ELSE p END)
  ELSE printf('%.2f', CASE WHEN p * 8 = floor(p * 8) AND (p * 8)::BIGINT % 2 = 1 THEN p + 0.001 ELSE p END) END AS shown,
 CASE WHEN l_discount > 0.05 THEN 'over' ELSE 'under' END AS side FROM (SELECT *, l_extendedprice AS p FROM lineitem)"""


@query(SHOWN_SQL)
def value_display(spark, sf):
    """Every lineitem row."""
    from ..functions.display import value_text

    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value_text(p).alias("shown"), F.when(F.col("l_discount") > 0.05, "over").otherwise("under").alias("side"))


@query(SHOWN_SQL)
def value_display_whole(spark, sf):
    return value_display(spark, sf)


@query("""SELECT c_mktsegment, list_transform(range(5), lambda i: lo + (hi - lo) * i / 4) AS ticks FROM (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1) WHERE hi > lo""")
def axis_ticks(spark, sf):
    from ..functions.display import ticks

    span = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).where("hi > lo")
    return span.select("c_mktsegment", ticks(F.col("lo"), F.col("hi"), 400, 100).alias("ticks"))


@query("""SELECT p_partkey, floor(((23 + h * 137.508::DOUBLE) % 360) + 0.5)::INT AS hue, (52 + h % 24)::INT AS sat FROM (
 SELECT p_partkey, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_type, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296)::BIGINT AS h FROM part)""")
def name_colors(spark, sf):
    from ..functions.display import hue

    return table(spark, sf, "part").withColumn("c", hue(F.col("p_type"))).select("p_partkey", "c.hue", "c.sat")
