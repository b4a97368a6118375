"""Queries of whole record sets: building and publishing, tolerant loads, charsets, radar rings, property subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import radar as R
from ..operators import stats as S
from ..scratch import folder
from ..sources import build as B
from ..sources import encoding as E
from ..sources import readers
from .catalog import MAT, OBS, STAT, materials, measured, observations, query, rounded, table

AXES = ["quantity", "hardness", "extendedprice", "discount", "tax"]
SERIES = f"""{OBS}, {MAT}, span AS (SELECT property_key, min(value) + 0.0 AS lo, max(value) + 0.0 AS hi FROM obs WHERE value IS NOT NULL GROUP BY 1 HAVING max(value) > min(value)),
stat AS (SELECT base_material AS series, property_key, avg(value) AS value FROM obs JOIN mat USING (material_id) WHERE NOT (property_key = 'discount' AND length(base_material) % 2 = 0) GROUP BY 1, 2),
axes AS (SELECT property_key, lo, hi, row_number() OVER (ORDER BY list_position(['quantity', 'hardness', 'extendedprice', 'discount', 'tax'], property_key)) - 1 AS i, count(*) OVER () AS n
  FROM span WHERE property_key IN (SELECT property_key FROM stat WHERE value IS NOT NULL) AND property_key IN ('quantity', 'hardness', 'extendedprice', 'discount', 'tax')),
pts AS (SELECT series, property_key, i, n, greatest(0.0, least(1.0, (value - lo) / (hi - lo))) AS norm FROM stat JOIN axes USING (property_key)),
ends AS (SELECT *, cos(i * 2 * pi() / n - pi() / 2) * norm * 122 AS x, sin(i * 2 * pi() / n - pi() / 2) * norm * 122 AS y FROM pts)"""


def series(spark, sf):
    """The axes that stay, and every base material's pooled means."""
    obs = observations(spark, sf)
    joined = obs.join(materials(spark, sf).select("material_id", F.col("base_material").alias("series")), "material_id")
    joined = joined.where(~((F.col("property_key") == "discount") & (F.length("series") % 2 == 0)))
    stat = joined.groupBy("series", "property_key").agg(F.avg("value").alias("value"))
    return stat, R.kept_axes(stat, S.ranges(obs), AXES)


@query(f"""WITH {SERIES} SELECT a.series, CAST(a.i AS INT) AS i, a.property_key AS from_key, b.property_key AS to_key, round(a.x, 5) + 0.0 AS x1, round(a.y, 5) + 0.0 AS y1, round(b.x, 5) + 0.0 AS x2, round(b.y, 5) + 0.0 AS y2
FROM ends a JOIN ends b ON b.series = a.series AND b.i = (a.i + 1) % a.n""")
def radar_segments(spark, sf):
    """Segments between present neighbours of every base material's ring; one axis has no numbers, one is missing for some."""
    made = R.segments(R.rings(*series(spark, sf)))
    return made.withColumns({c: F.round(F.col(c), 5) + 0.0 for c in ("x1", "y1", "x2", "y2")})


@query(f"""WITH {SERIES} SELECT series, CAST(max(n) - count(*) AS INT) AS missing, max(n) = count(*) AS complete, string_agg(property_key, ',' ORDER BY i) AS present FROM ends GROUP BY 1""")
def radar_rings(spark, sf):
    """How many axes each series lacks, and those it has in the ring's order."""
    made = R.rings(*series(spark, sf))
    return made.select("series", "missing", "complete", F.array_join(F.transform(F.array_compact("points"), lambda p: p["key"]), ",").alias("present"))


#: Subsets of the stand-in properties, each in an order of its own.
LISTS = {"hero": ["tax", "quantity"], "thermal": ["extendedprice", "hardness", "discount"], "radar": ["discount", "tax", "extendedprice", "quantity"], "basic": ["quantity", "tax"]}
_LISTS = ", ".join(f"('{n}', {keys})" for n, keys in LISTS.items())


@query(f"""WITH {OBS}, {STAT}, lists(subset, keys) AS (VALUES {_LISTS}), k AS (SELECT subset, unnest(keys) AS property_key, unnest(range(len(keys))) AS ord FROM lists)
SELECT material_id, subset, CAST(ord AS INT) AS ord, property_key, round(mean_value + 0.000000013, 6) AS mean_value FROM stat JOIN k USING (property_key)""")
def property_subsets(spark, sf):
    """Hero, thermal, radar and basic figures of every record, in each subset's order."""
    return rounded(R.subsets(measured(spark, sf), LISTS), "mean_value")


@query(r"""WITH p AS (SELECT page_id, page_id % 5 AS k, CASE WHEN page_id % 5 > 2 THEN replace(html, '<meta charset="utf-8">', '') ELSE html END AS html FROM pages),
q AS (SELECT *, regexp_full_match(html, '[\x{00}-\x{7F}\x{A0}-\x{FF}]*', 's') AS latin, regexp_full_match(html, '[\x{00}-\x{7F}]*', 's') AS plain FROM p)
SELECT page_id, md5(html) AS html_md5, CASE WHEN k = 1 THEN 'utf-16-le' WHEN k = 2 AND latin THEN 'cp1252' WHEN k = 4 AND latin AND NOT plain THEN 'cp1252' ELSE 'utf-8' END AS charset FROM q""")
def page_charsets(spark, sf):
    """Every page encoded one of five ways (own word, mark, header, bytes alone in two charsets) comes back as it was."""
    k = F.col("page_id") % 5
    page = F.when(k > 2, F.replace("html", F.lit('<meta charset="utf-8">'), F.lit(""))).otherwise(F.col("html"))
    pages = table(spark, sf, "pages").select("page_id", page.alias("html")).withColumn("latin", F.col("html").rlike(r"(?s)^[\x{00}-\x{7F}\x{A0}-\x{FF}]*$"))
    one_byte = F.encode(F.when(F.col("latin"), F.col("html")).otherwise(F.lit("")), "ISO-8859-1")
    utf8 = F.encode("html", "UTF-8")
    marked = F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE"))
    body = F.when(k == 1, marked).when(k.isin(2, 4) & F.col("latin"), one_byte).otherwise(utf8)
    header = F.when((k == 2) & F.col("latin"), "text/html; charset=ISO-8859-1").when(k == 3, "text/html; charset=no-such").when(k < 2, "text/html")
    got = pages.select("page_id", body.alias("body"), header.alias("header")).withColumn("d", E.page_text(F.col("body"), F.col("header")))
    return got.select("page_id", F.md5("d.text").alias("html_md5"), F.col("d.charset").alias("charset"))


#: Documents of the tolerant load.
DOCUMENTS = 40


@query(f"""WITH d AS (SELECT p_partkey % {DOCUMENTS} AS doc, count(*) AS n, count(*) FILTER (p_size IS NOT NULL) AS obs, sum(p_size) AS total FROM part GROUP BY 1),
s AS (SELECT *, CASE doc % 5 WHEN 1 THEN 'broken' WHEN 2 THEN 'no_materials' ELSE 'ok' END AS status FROM d)
SELECT status, count(*) AS files, CAST(sum(CASE WHEN status = 'ok' THEN n ELSE 0 END) AS BIGINT) AS materials, CAST(sum(CASE WHEN status = 'ok' THEN obs ELSE 0 END) AS BIGINT) AS observations,
  CAST(sum(CASE WHEN status = 'ok' THEN total ELSE 0 END) AS DOUBLE) AS total FROM s GROUP BY 1
UNION ALL SELECT 'missing', 1, 0, 0, 0.0""")
def tolerant_load(spark, sf):
    """Published documents made of part: some broken, some without a list, one absent. Status rows, and what the good ones hold."""
    number = F.col("p_partkey") % DOCUMENTS
    one = F.struct(F.col("p_partkey").cast("string").alias("material_id"), F.col("p_brand").alias("supplier"), F.array(F.struct(F.lit("size").alias("property_key"), F.col("p_size").alias("value_nominal"))).alias("observations"))
    held = table(spark, sf, "part").groupBy(number.alias("doc")).agg(F.to_json(F.struct(F.collect_list(one).alias("materials"))).alias("value"))  # a stand-in for a file
    text = F.when(F.col("doc") % 5 == 1, F.substring("value", 1, 40)).when(F.col("doc") % 5 == 2, '{"rows": []}').otherwise(F.col("value"))
    root = f"{folder(spark)}/published"
    held.withColumn("value", text).repartition(4, "doc").write.partitionBy("doc").text(root)
    mats, obs, status = readers.loaded(spark, root, ["doc=99/none.txt"], "*.txt")
    per = obs.groupBy("file").agg(F.count("value_nominal").alias("observations"), F.sum("value_nominal").alias("total"))
    per = mats.groupBy("file").agg(F.count(F.lit(1)).alias("read")).join(per, "file", "left")
    every = status.join(per, "file", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return every.groupBy("status").agg(F.count(F.lit(1)).alias("files"), zero("read").alias("materials"), zero("observations").alias("observations"), zero("total").cast("double").alias("total"))


@query("""WITH d AS (SELECT p_partkey AS k, p_brand || '/PLA ' || p_partkey || '.pdf' AS source_file, round(1 + p_size / 100.0, 2) AS value FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY source_file) AS id FROM d WHERE k % 4 = 0)
SELECT CASE d.k % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'error' WHEN 2 THEN 'needs_ocr' ELSE 'no_properties_found' END AS status, count(*) AS materials, count(o.id) AS observations,
  CAST(coalesce(sum(o.id), 0) AS BIGINT) AS ids, CAST(coalesce(sum(o.id * o.value), 0) AS DECIMAL(18, 2)) AS weighed FROM d LEFT JOIN o USING (k) GROUP BY 1""")
def built_set(spark, sf):
    """Datasheets made of part, built, published, verified and read back: records by status, their observations, and the running ids' order."""
    k = F.col("p_partkey")
    sheet = F.concat(F.lit("Density | "), F.format_string("%.2f", 1 + F.col("p_size") / 100), F.lit(" g/cm3"))
    docs = table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/PLA "), k, F.lit(".pdf")).alias("source_file"), F.when(k % 4 == 3, F.repeat(F.lit("words without any "), 10)).otherwise("").alias("text"),
        F.when(k % 4 == 0, F.array(sheet)).otherwise(F.array().cast("array<string>")).alias("rows"), F.lit(1).alias("pages"), F.when(k % 4 == 1, "no file").alias("error"),
    )
    path = folder(spark)
    B.publish(B.build(docs), path)
    read = B.published(spark, path)
    joined = read["materials"].select("material_id", "status").join(read["observations"].select("material_id", "observation_id", "value_nominal"), "material_id", "left")
    weighed = F.col("observation_id") * F.col("value_nominal").cast("decimal(10,2)")
    return joined.groupBy("status").agg(
        F.countDistinct("material_id").alias("materials"), F.count("observation_id").alias("observations"), F.coalesce(F.sum("observation_id"), F.lit(0)).alias("ids"),
        F.coalesce(F.sum(weighed), F.lit(0)).cast("decimal(18,2)").alias("weighed"),
    )
