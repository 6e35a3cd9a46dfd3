"""Every registered query against its check SQL on the smallest tables."""

import pytest

import compare
from riskloom.plans.catalog import ORACLES, QUERIES

# Empty on 200 documents; covered by the larger tables and by the fixtures of the other tests.
MAY_BE_EMPTY = {
    "chain_download_chmod", "local_modules", "asset_findings", "file_type_breakdown", "coverage_findings",
    "chain_laundering", "zero_width_breakdown", "zero_width_density", "complementary_descriptions", "manifest_contradictions", "facet_filters", "stream_hourly_counts", "import_featured", "package_siblings",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    s_cols, s_rows, d_cols, d_rows = compare.compare(df, ORACLES[name], con)
    assert s_cols == d_cols
    assert s_rows == d_rows
    assert s_rows or name in MAY_BE_EMPTY
