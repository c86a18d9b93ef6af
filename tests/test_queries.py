"""Every query against its DuckDB SQL, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry
from symlattice.oracles import ORACLES
from symlattice.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    mine = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(rows, key=repr)


def test_typedef_lines_has_every_typedef(spark, duck):
    """Part typedefs too, each with a line."""
    got = {r["root_id"] for r in QUERIES["typedef_lines"](spark, SF).collect()}
    parts = {5_000_000_000 + p for (p,) in duck.execute("SELECT p_partkey FROM part WHERE p_size % 4 = 2").fetchall()}
    assert len(parts) > 25 and got == parts | {11_000_000_000 + n for n in range(25)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
