"""Every registered query against its SQL oracle on the smallest data folder."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from holdfast.plans import catalog  # noqa: E402
from tools import check_queries as cq  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in cq.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert cq.canonical(got.astype(object).where(got.notna(), None)) == cq.canonical(
        want.astype(object).where(want.notna(), None)
    )
