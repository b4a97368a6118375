"""Texts that many rows share are worked out once, in many tasks; small files with much work a row aren't one task."""

import pytest

from strandline.operators import issues as I
from strandline.operators import repeats
from strandline.plans import audit_catalog, catalog, record_catalog, text_catalog  # noqa: F401


@pytest.mark.parametrize("limit", [0, 16_000_000])
def test_issue_texts_once(spark, sf, monkeypatch, limit):
    seen, features = [], I.text_features

    def counted(texts):
        seen.append((texts.count(), texts.rdd.getNumPartitions()))
        return features(texts)

    monkeypatch.setattr(I, "text_features", counted)
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", limit)
    obs = audit_catalog.planted(spark, sf)
    obs = obs.unionByName(obs.limit(1).selectExpr(*["null AS raw_value" if c == "raw_value" else c for c in obs.columns]))
    got = I.detect(obs).groupBy("issue_type").count().count()
    assert seen == [(len(audit_catalog.CASES) + 1, 4)] and got >= 22


def test_small_files_are_spread(spark, sf):
    assert audit_catalog.planted(spark, sf).rdd.getNumPartitions() == 4
    assert audit_catalog.checked(spark, sf).rdd.getNumPartitions() == 4
    assert catalog.QUERIES["classify_material"](spark, sf).rdd.getNumPartitions() == 4


def test_figures_have_one_group_a_record(spark, sf):
    from strandline.operators import stats as S

    rows = spark.createDataFrame([(1, 2.0, None), (1, -0.0, None), (2, None, 5.0), (3, None, None)], "material_id long, a double, b double")
    long = rows.selectExpr("material_id", "stack(2, 'a', a, 'b', b) AS (property_key, value)")
    assert sorted(S.wide_stat(rows, ["a", "b"]).collect()) == sorted(S.material_stat(long).collect())
    for name in ("material_stat", "material_map", "property_subsets", "radar_max", "printability"):  # no row a property below the groups
        assert "stack(" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString(), name


def test_pages_are_spread_and_documents_parsed_once(spark, sf):
    from strandline.plans import collect_catalog

    assert collect_catalog.shop(spark, sf).rdd.getNumPartitions() == 4
    plan = catalog.QUERIES["product_json_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("$.price") == 1


def test_quick_looks_change_no_text(spark):
    """Texts that are passed over have no mass, and no sign of web pages to make alike."""
    from pyspark.sql import functions as F

    from strandline.functions import classify, units
    from strandline.functions.text import squeeze

    some = ["", "red", "PLA 750 g", "1 Kg", "1 Kg", "2 X 500G", "2 × .5 kg", "3\n \tlbs", "k 5", "9", "moq 1 kg x", None, "5 Pounds", "1 2  3"]
    odd = ["a  b", " a", "a ", "a/b", "5 mm / s", "5 mm /sec", "5 mm/s.", "1 g / cm3", "1 g / 10 min", "1 ~ 2", "a\tb", "20 °C", "a\n", "ab", "it's {ok} - 3/4"]
    df = spark.createDataFrame([(t,) for t in some + odd], "t string")
    t = F.col("t")
    found = df.select("t", units.largest_mass(t).alias("a"), units.largest(units.mass_candidates(t)).alias("b"), classify.page_space(t).alias("tidy"), squeeze(t).alias("plain")).collect()
    assert [r.t for r in found if r.a != r.b] == [] and sum(r.a is not None for r in found) >= 6
    same = {r.t for r in found if r.tidy == (r.t or "")}
    assert {"ab", "a/b", "it's {ok} - 3/4", "", None} <= same and not same & {"a  b", " a", "a ", "a\tb", "a\n", "1 ~ 2", "5 mm / s", "5 mm /sec", "5 mm/s.", "1 g / cm3", "1 g / 10 min", "20 °C"}


def test_few_properties_are_no_shuffle_key(spark, sf):
    for name in ("plausibility_split", "strict_range_violations", "fx_conversion"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan, name


def test_records_are_gathered_once(spark, sf):
    """All rows of a record come to one task by one shuffle, before properties become rows; groups and windows over records need no other."""
    from strandline.plans import detail_catalog  # noqa: F401

    for name in ("property_groups", "observation_dedupe", "material_stat"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(shuffles) == 1 and "hashpartitioning(material_id" in shuffles[0] and "REPARTITION_BY_NUM" in shuffles[0], name


def test_more_tasks_for_more_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_LINES", 1000)
    lines = catalog.table(spark, sf, "lineitem").count()
    for df in (catalog.observations(spark, sf, by_record=True), catalog.measured(spark, sf)):
        assert df.rdd.getNumPartitions() == -(-lines // 1000) > 4


def test_ranges_of_properties_cause_no_shuffle_of_records(spark, sf):
    for name in ("db_range_normalised", "fingerprint"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(material_id") == 1, name
