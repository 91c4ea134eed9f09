"""Every registered query against its DuckDB text at the smallest size; those without one must run."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from motorlens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(df, columns):
    def cell(v):
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    df = df[columns].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(entry.__file__).parent
    for path in root.glob("motorlens/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"motorlens\.llm|from \.+llm|import llm", path.read_text()), path
