"""Queries against their SQL oracles, and the registered names."""

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from holdfast.llm import queries  # noqa: E402
from tools import check_queries as cq  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()
    assert cq.canonical(got.astype(object).where(got.notna(), None)) == cq.canonical(
        want.astype(object).where(want.notna(), None)
    )


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "minhash_near_dedup", "source_mixing", "packing"
    ]
