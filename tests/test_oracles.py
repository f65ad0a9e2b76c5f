"""Every query of the core against its SQL, over the small test tables."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import pytest

from orrery.plans import catalog_queries, general_queries, graph_queries, map_queries, serving_queries, source_queries, streaming_queries
from tests.conftest import SF

MODULES = [catalog_queries, serving_queries, map_queries, graph_queries, general_queries, streaming_queries, source_queries]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return list(v) if isinstance(v, (list, tuple)) else v


def compare(spark, duck, name, queries=QUERIES, oracles=ORACLES):
    df = queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(oracles[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    if len(got) == len(want) and got != want:
        for a, b in zip(got, want):
            assert a == pytest.approx(b, abs=2e-3) if all(isinstance(x, (int, float)) for x in a) else a == b
    assert len(got) == len(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    """Every node has one row, and finite numbers."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    nodes = graph_queries._layout_nodes(spark, SF).select("id").distinct().count()
    assert len(rows) == len({r["id"] for r in rows}) >= nodes
    assert all(v is not None and math.isfinite(v) for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "nc"]
    assert set(e.oracle_sql()) <= set(e.queries())
