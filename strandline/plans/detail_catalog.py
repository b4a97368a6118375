"""Queries of counters, record pages, plot windows, titles and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import beam as B
from ..operators import detail as D
from ..operators import stats as S
from .catalog import KEYS, MAT, OBS, STAT, materials, observations, query, rounded, table

KPIS_SQL = f"""WITH {OBS}, {MAT}, per AS (SELECT property_key, count(DISTINCT material_id) AS n FROM obs GROUP BY 1)
SELECT count(*) AS materials, 100.0 * count(*) FILTER (live) / count(*) AS parsed_percent, count(DISTINCT base_material) FILTER (live) AS bases,
 count(DISTINCT supplier) AS suppliers, (SELECT property_key FROM per ORDER BY n DESC, list_position(['quantity', 'extendedprice', 'discount', 'tax'], property_key) LIMIT 1) AS best_property,
 (SELECT max(n) FROM per) AS best_materials
FROM (SELECT *, material_id IN (SELECT material_id FROM obs) AS live FROM mat)"""
LEGEND_SQL = f"""WITH {MAT} SELECT base_material AS group_value, count(*) AS n FROM mat WHERE material_id IN (SELECT l_partkey FROM lineitem) GROUP BY 1"""


@query(KPIS_SQL)
def kpis(spark, sf):
    return D.kpis(materials(spark, sf), observations(spark, sf), KEYS)


@query(LEGEND_SQL)
def base_legend(spark, sf):
    return D.legend(materials(spark, sf), observations(spark, sf))


@query(KPIS_SQL)
def kpis_whole(spark, sf):
    return kpis(spark, sf)


@query(LEGEND_SQL)
def base_legend_whole(spark, sf):
    return base_legend(spark, sf)


@query(f"""WITH {OBS}, once AS (SELECT * FROM obs WHERE property_key <> 'discount' QUALIFY row_number() OVER (PARTITION BY material_id, property_key, value ORDER BY ordinal, orientation) = 1),
named AS (SELECT *, CASE property_key WHEN 'quantity' THEN 'Physical' WHEN 'tax' THEN 'Thermal' ELSE 'Other' END AS section FROM once)
SELECT material_id, section, coalesce(list_position(['Filament specs', 'Print settings', 'Mechanical', 'Thermal', 'Physical', 'Electrical', 'Safety / chemical', 'Other'], section) - 1, 99) AS place, count(*) AS n, min(ordinal) AS first_ordinal
FROM named GROUP BY 1, 2, 3""")
def property_groups(spark, sf):
    obs = observations(spark, sf, by_record=True).withColumn("category", F.when(F.col("property_key") == "tax", "Thermal").otherwise(""))
    known = spark.createDataFrame([("quantity", "Physical"), ("tax", "Print settings")], "property_key string, category string")
    scope = spark.createDataFrame([(k,) for k in KEYS if k != "discount"], "property_key string")
    made = D.property_groups(obs, known, ["material_id", "property_key", "value"], [F.col("ordinal"), F.col("orientation")], scope)
    return made.groupBy("material_id", "section", "place").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first_ordinal"))


@query(f"""WITH {OBS}, {STAT}, span AS (SELECT property_key, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1),
keys(property_key, metric_order) AS (VALUES ('quantity', 0), ('hardness', 1), ('tax', 2)), ids AS (SELECT p_partkey AS material_id FROM part)
SELECT i.material_id, k.metric_order, k.property_key, round(s.mean_value + 0.000000013, 6) AS mean_value, coalesce(s.n, 0) AS n,
 round(CASE WHEN s.mean_value IS NULL OR hi = lo THEN 0 ELSE greatest(0, least(1, (s.mean_value - lo) / (hi - lo))) END + 0.000000013, 6) AS score
FROM ids i CROSS JOIN keys k LEFT JOIN stat s ON s.material_id = i.material_id AND s.property_key = k.property_key LEFT JOIN span p ON p.property_key = k.property_key""")
def metric_panel(spark, sf):
    obs = observations(spark, sf)
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("material_id"))
    return rounded(D.metric_panel(S.material_stat(obs), S.ranges(obs), ["quantity", "hardness", "tax"], ids), "mean_value", "score")


@query("""WITH l AS (SELECT l_partkey AS material_id, l_returnflag || l_linestatus AS m, strftime(l_shipdate, '%Y-%m-%d') AS c FROM lineitem)
SELECT material_id, array_to_string(list_sort(list(DISTINCT m))[1:12], '; ') AS test_method, array_to_string(list_sort(list(DISTINCT c))[1:4], '; ') AS source_context FROM l GROUP BY 1""")
def sources_panel(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("material_id"), F.concat("l_returnflag", "l_linestatus").alias("test_method"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("source_context"),
    )
    return D.sources_panel(rows)


@query(f"""WITH {MAT}, n AS (SELECT l_partkey, count(*) * 4 AS n FROM lineitem GROUP BY 1)
SELECT material_id, product || chr(10) || supplier || ' / ' || base_material || ' / ' || material_family || chr(10) || coalesce(n, 0) || ' extracted observations' || chr(10) || 'parsed' AS tip
FROM mat LEFT JOIN n ON l_partkey = material_id""")
def material_tip(spark, sf):
    n = observations(spark, sf).groupBy("material_id").agg(F.count(F.lit(1)).alias("n"))
    tip = D.material_tip(F.col("product"), F.col("supplier"), F.col("base_material"), F.col("material_family"), F.col("n"), F.lit("parsed"))
    return materials(spark, sf).join(n, "material_id", "left").select("material_id", tip.alias("tip"))


@query("""WITH s AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi, avg(c_acctbal) AS middle FROM customer GROUP BY 1),
v AS (SELECT *, greatest(lo + (hi - lo) / 8, least(hi - (hi - lo) / 8, middle)) AS c FROM s), w AS (SELECT *, c - (hi - lo) / 8 AS vlo, c + (hi - lo) / 8 AS vhi FROM v),
z AS (SELECT *, vlo + 0.25 * (vhi - vlo) AS val, (hi - lo) / 4.8 AS span FROM w)
SELECT c_mktsegment, round(vlo, 6) AS shown_lo, round(vhi, 6) AS shown_hi, 4.8::DOUBLE AS zoom, round(greatest(lo + span / 2, least(hi - span / 2, val - 0.25 * span + span / 2)), 6) AS center FROM z""")
def plot_window(spark, sf):
    span = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.avg("c_acctbal").alias("at"))
    seen = span.withColumn("v", D.shown_range(F.col("lo"), F.col("hi"), F.col("at"), F.lit(4.0)))
    then = seen.withColumn("z", D.zoomed(F.col("lo"), F.col("hi"), F.col("v"), F.lit(4.0), F.lit(0.25), F.lit(True)))
    places = lambda c: F.round(c, 6)
    return then.select("c_mktsegment", places("v.lo").alias("shown_lo"), places("v.hi").alias("shown_hi"), places("z.zoom").alias("zoom"), places("z.center").alias("center"))


@query("""WITH o AS (SELECT user_id AS vendor, 'https://shop.example/products/p' || (event_id % 7) AS url, CASE WHEN value > 60 THEN 'hint ' || event_id ELSE '' END AS hint,
 CASE WHEN event_type = 'click' THEN 'html_sidecar' ELSE 'seed' END AS source, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS part, event_id FROM events),
k AS (SELECT *, max(hint <> '') OVER (PARTITION BY vendor, url) AS h FROM o),
d AS (SELECT * FROM k WHERE NOT h OR hint <> '' QUALIFY row_number() OVER (PARTITION BY vendor, url ORDER BY CASE WHEN h THEN 1 ELSE -1 END * part, CASE WHEN h THEN 1 ELSE -1 END * event_id) = 1)
SELECT vendor, url, hint, source FROM d QUALIFY row_number() OVER (PARTITION BY vendor ORDER BY CASE WHEN source = 'html_sidecar' THEN 0 ELSE 1 END, url) <= CASE WHEN vendor % 2 = 0 THEN 2 ELSE 4 END""")
def candidate_discovery(spark, sf):
    from ..operators.prices import discover

    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("vendor"), F.concat(F.lit("https://shop.example/products/p"), F.col("event_id") % 7, F.lit("/?v=1#top")).alias("url"),
        F.when(F.col("value") > 60, F.concat(F.lit("hint "), "event_id")).otherwise("").alias("hint"), F.col("event_id").alias("place"), "event_type",
    )
    side = rows.where("event_type = 'click'").withColumn("source", F.lit("html_sidecar"))
    rest = rows.where("event_type <> 'click'").withColumn("source", F.lit("seed"))
    limits = table(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("vendor"), F.lit(2).alias("product_limit")).distinct()
    return discover([side, rest], limits, 4)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Converted from source value ' || p_size || ' psi (psi to MPa) for metric comparison.' ELSE '' END
 || CASE WHEN p_size % 6 = 0 THEN '|' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'The source''s unit could not be converted safely.' ELSE '' END AS notes FROM part""")
def conversion_notes(spark, sf):
    from ..functions.display import quality_notes

    size = F.col("p_size")
    flags = F.concat_ws(";", F.when(size % 2 == 0, "unit_converted:psi->MPa"), F.when(size % 3 == 0, "unit_not_converted"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(quality_notes(flags, size.cast("string"), F.lit("psi")), "|").alias("notes"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS title FROM pages""")
def title_extract(spark, sf):
    from ..sources.html import parse_pages

    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return parse_pages(pages).select(F.col("url").cast("long").alias("page_id"), F.coalesce(X.squeeze(F.col("title")), F.lit("")).alias("title"))


@query("""WITH e AS (SELECT p_partkey AS model, p_size::DOUBLE AS s FROM part), a AS (SELECT *, CASE WHEN model % 2 = 0 THEN s * s ELSE -s * s END AS area FROM e),
l AS (SELECT model, unnest(['point', 'short', 'wide']) AS id, unnest([-3.2, 1.0, -5.0]) AS x1, unnest([NULL, 1.4, 900.0]) AS x2 FROM e)
SELECT a.model, id, area, s / 2 - (greatest(50, s) + 88) / 4 AS view_lo, least(greatest(floor(x1 + 0.5), 0), s) AS x1, CASE WHEN x2 IS NOT NULL THEN least(greatest(floor(x2 + 0.5), 0), s) END AS x2,
 CASE WHEN model % 2 = 0 THEN 0.0 ELSE 0.0 END AS first_x, CASE WHEN model % 2 = 0 THEN 0.0 ELSE 0.0 END AS first_y, CASE WHEN model % 2 = 0 THEN s ELSE s END AS second_x
FROM a JOIN l USING (model) WHERE x2 IS NULL OR abs(least(greatest(floor(x1 + 0.5), 0), s) - least(greatest(floor(x2 + 0.5), 0), s)) >= 1""")
def fitted_loads(spark, sf):
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(zero, zero), p(s, zero), p(s, s), p(zero, s))
    back = F.array(p(zero, s), p(s, s), p(s, zero), p(zero, zero))
    shapes = table(spark, sf, "part").select(F.col("p_partkey").alias("model"), F.when(F.col("p_partkey") % 2 == 0, ring).otherwise(back).alias("points"))
    bounds = B.polygon_area(shapes)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("x1"), F.lit(b).cast("double").alias("x2")) for i, a, b in (("point", -3.2, None), ("short", 1.0, 1.4), ("wide", -5.0, 900.0))]))
    loads = B.fitted(shapes.select("model", rows.alias("l")).select("model", "l.*"), bounds, 1.0)
    view = bounds.join(shapes, "model").select(
        "model", "area", B.padded(F.col("min_y"), F.col("max_y"), 50, 44, F.lit(2.0))["lo"].alias("view_lo"), B.turned(F.col("points"), F.col("area")).alias("t"),
    )
    return loads.join(view, "model").select("model", "id", "area", "view_lo", "x1", "x2", F.col("t")[0]["x"].alias("first_x"), F.col("t")[0]["y"].alias("first_y"), F.col("t")[1]["x"].alias("second_x"))
