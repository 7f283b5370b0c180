"""The registered queries: results with SQL against DuckDB, the others by their contracts, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from wavelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
KEYS = {"op2_html": ("page_id", "pages"), "op8_embeddings": ("vec_id", "embeddings"), "op12_prefix_trie": (None, "conversations"), "op11_collocations": (None, "documents")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    rows = got.collect()
    key, table = KEYS.get(name, ("doc_id", "documents"))
    assert key is None or sorted(r[key] for r in rows) == [x for (x,) in duck.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if name in Q.ORACLE:
        said = duck.execute(Q.ORACLE[name])
        names = [c[0] for c in said.description]
        assert set(got.columns) == set(names)
        assert sorted(map(str, (tuple(r[c] for c in names) for r in rows))) == sorted(map(str, said.fetchall()))
