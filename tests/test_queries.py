"""Every registered query beside its SQL counterpart on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"


def _load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


entry = _load("driver_entry", ROOT / "__spark_entry__.py")
check = _load("check_queries", ROOT / "tools" / "check_queries.py")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = check.rows_of([tuple(r) for r in df.collect()], [df.columns.index(c) for c in order])
    assert got == check.rows_of(cur.fetchall(), [names.index(c) for c in order])


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 49
