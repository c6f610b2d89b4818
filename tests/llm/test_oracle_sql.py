"""Corpus queries that SQL can express equal their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

registry = pytest.importorskip("marlstone.llm.registry")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(registry.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in c.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()]
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got) == key(want)
