"""The registered queries: that they run over the smallest tables and agree with their SQL."""

from __future__ import annotations

import importlib
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from fieldloom.plans import catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return c


def plain(row):
    return tuple("~" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(plain, got.select(*[f"`{c}`" for c in columns]).collect())) == sorted(map(plain, want.fetchall()))


def test_entry_module():
    again = importlib.reload(driver)
    names = set(again.queries())
    assert set(catalogue.QUERIES) <= names and set(again.oracle_sql()) <= names
    assert ("pipeline" in names) == again.HAS_PIPELINE


def test_missing_libraries_of_the_training_operators_leave_the_other_queries(monkeypatch):
    real = importlib.import_module

    def missing(name, *args):
        if name == "fieldloom.llm.queries":
            raise ModuleNotFoundError("no such library")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    try:
        alone = importlib.reload(driver)
        assert set(alone.queries()) == set(catalogue.QUERIES) and set(alone.oracle_sql()) == set(catalogue.ORACLE_SQL)
        assert not alone.HAS_LLM and not alone.HAS_PIPELINE
    finally:
        monkeypatch.undo()
        importlib.reload(driver)
