"""The archive queries over several files, against their SQL and file by file."""

import duckdb
import pytest
from test_queries import SF, rows

from wavelake import queries as Q
from wavelake.plans import adapters as X

BIG = SF.replace("0.001", "0.01")
WHOLE = ["stream_archive", "merge_archive", "envelope_archive", "segments_archive", "validate_archive"]


@pytest.fixture
def small_files(monkeypatch):
    """Files of 22 records, so that 10,000 events are 5 of them, each but the last with a gap."""
    monkeypatch.setattr(X, "FILE_RECORDS", 22)
    monkeypatch.setattr(X, "_written", {})


@pytest.mark.parametrize("name", WHOLE)
def test_archive_query(spark, small_files, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{BIG}/events.parquet'")
    said = con.execute(Q.ORACLE[name].replace("200000", "2200"))
    names = [c[0] for c in said.description]
    got = Q.QUERIES[name](spark, BIG)
    assert sorted(got.columns) == sorted(names)
    found = got.collect()
    assert rows(got.columns, found) == rows(names, said.fetchall())
    assert "file" not in names or {r["file"] for r in found} == set(range(5))


def test_flagship_covers_every_file(spark, small_files):
    found = Q.flagship(spark, BIG).groupBy("path").count().collect()
    assert sorted(r["count"] for r in found) == [1000] * 5
