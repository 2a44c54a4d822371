"""Every registered query of the inventory against its oracle, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog, inventory, inventory_audit, inventory_fuzzy, inventory_grids, inventory_more, inventory_pages, inventory_ports, inventory_retrieval, inventory_review, inventory_rows, inventory_sea, inventory_state, inventory_zones  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


#: Queries whose results hang on random draws; tests/test_anomalies.py compares them with plain loops.
WITHOUT_ORACLE = {"agg_48_spatial_anomalies", "agg_50_isolation_scores"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - WITHOUT_ORACLE))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(norm(tuple(r))) for r in df.select(columns).collect()) == sorted(repr(norm(r)) for r in found.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_ORACLE
