"""Values that 16 bits don't hold, against the SQL: recordings of 4 records, of which the second has no such value."""

from pathlib import Path

import duckdb
import pytest
from test_queries import SF

from wavelake import file_queries
from wavelake import queries as Q
from wavelake.plans import adapters as X

WIDE = {3: 655.36, 7: 700.0, 99: -0.01, 150: 1311.0, 399: 21474836.47, 805: -21474508.8, 949: 800.25}
NAMES = ["edf_roundtrip_samples", "edf_roundtrip_physical", "envelope_archive", "merge_archive", "sample_by_byte_range", "signal_stats", "stream_archive", "trim_archive", "windows_archive"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("wide")
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in WIDE.items())
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(CASE event_id {cases} ELSE value END AS DOUBLE) AS value) FROM '{SF}/events.parquet' WHERE event_id < 950 ORDER BY event_id) TO '{d}/events.parquet'")
    return str(d)


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(X, "FILE_RECORDS", 4)
    monkeypatch.setattr(file_queries, "FILE", 400)
    monkeypatch.setattr(X, "_written", {})


def check(spark, tables, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    said = con.execute(Q.ORACLE[name].replace("200000", "400"))
    names = [c[0] for c in said.description]
    got = Q.QUERIES[name](spark, tables)
    assert sorted(got.columns) == sorted(names)
    plain = lambda x: f"{x:.15g}" if isinstance(x, float) else str(x)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in said.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_wide_values(spark, small_files, tables, name):
    check(spark, tables, name)


def test_wide_values_by_urls(spark, small_files, tables, monkeypatch):
    """Without a server: paths of the files instead of URLs, read by blocks alike."""
    from wavelake.testing import server

    monkeypatch.setattr(server, "serve", lambda folder, host: sorted(str(p) for p in Path(folder).iterdir()))
    check(spark, tables, "http_roundtrip_samples")
