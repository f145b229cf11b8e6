import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import oracles

SF = "/root/testdata/sf0.001"
GRAPH = sorted(oracles.ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# The heavier plans are compared by the driver on every table size.
QUICK = [k for k in GRAPH if not k.startswith(("hybrid", "graph_c", "vector_n", "suggest"))]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    found, want = entry.queries()[name](spark, SF), duck.execute(entry.oracle_sql()[name])
    assert rows(found.columns, found.collect()) == rows([c[0] for c in want.description], want.fetchall())
