"""Registered queries against their SQL on the driver's smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import queries as graphs

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["out_degree", "isolated", "packed_vectors", "vertex_index_in", "vertex_ranges", "work_units", "frontier_pull_step", "pagerank_10", "pagerank_users", "cc_undirected", "bfs_parent_max", "pack_out_8"]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(graphs.oracle_sql()) <= set(graphs.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    ours = graphs.queries()[name](spark, SF_DIR)
    theirs = db.sql(graphs.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())
