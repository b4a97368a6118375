import pytest
from oracle import compare

from strandline.plans import audit_catalog, catalog, collect_catalog, detail_catalog, extract_catalog, record_catalog, text_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    assert compare(spark, SF, name, catalog.QUERIES[name], catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0
