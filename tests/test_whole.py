"""Registered queries return a row for every row they are about."""

import collections
import re
from decimal import ROUND_HALF_UP, Decimal

from strandline.functions.display import value_text
from strandline.plans import catalog, detail_catalog, text_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_natural_sort_key_of_every_part(spark):
    parts = {r.p_partkey: f"{r.p_name} {r.p_brand} {r.p_partkey}" for r in catalog.table(spark, SF, "part").collect()}
    got = {r.p_partkey: r.sort_key for r in catalog.QUERIES["natural_sort_key_whole"](spark, SF).collect()}
    assert got == {k: re.sub(r"[0-9]+", lambda m: m[0].lstrip("0").rjust(12, "0"), v.lower()) for k, v in parts.items()}
    assert len(got) == 200 and all(re.search(r"[0-9]", v) for v in got.values())


def shown(v):
    """The exact stored value, ties away from zero."""
    size = abs(v)
    places = 0 if size >= 1000 else 1 if size >= 100 else 2 if size >= 10 else 3
    text = format(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")
    return text.rstrip("0").rstrip(".") if places == 3 else text


def test_value_display_of_every_row(spark):
    rows = catalog.table(spark, SF, "lineitem").collect()
    want = collections.Counter((r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, shown(r.l_extendedprice), "over" if r.l_discount > 0.05 else "under") for r in rows)
    got = catalog.QUERIES["value_display_whole"](spark, SF).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert any(round(r.l_extendedprice * 100) % 10 == 5 for r in rows)


def test_value_text_of_ties(spark):
    values = [1234.5, 1235.5, 123.35, 123.45, 123.25, 12.345, 12.125, 12.135, 99.995, 1.0005, 1.0015, 0.0625, -123.35, -123.25, 1000.0, 100.0, 1.5, 999.95, 9.9995]
    values += [k / 100 for k in range(10005, 100000, 370)] + [k / 1000 for k in range(10005, 100000, 370)] + [k / 10000 for k in range(10005, 100000, 370)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", value_text(df.v).alias("t")).collect()
    assert [(r.v, r.t) for r in got if r.t != shown(r.v)] == []


def test_kpis_of_all_materials(spark):
    seen = {r.l_partkey for r in catalog.table(spark, SF, "lineitem").select("l_partkey").distinct().collect()}
    parts = {r.p_partkey: r.p_type for r in catalog.table(spark, SF, "part").collect()}
    (row,) = catalog.QUERIES["kpis_whole"](spark, SF).collect()
    assert (row.materials, row.parsed_percent, row.best_materials) == (len(parts), 100.0 * len(seen & set(parts)) / len(parts), len(seen))
    legend = {r.group_value: r.n for r in catalog.QUERIES["base_legend_whole"](spark, SF).collect()}
    assert legend == collections.Counter(v for k, v in parts.items() if k in seen)
