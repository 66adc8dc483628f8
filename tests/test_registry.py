"""Every registered query of the mail engine against its SQL on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows
    if name in ORACLES:
        wanted = tables.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        at = [wanted.columns.index(c) for c in found.columns]
        assert rows == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    real = entry.importlib.import_module

    def gone(name):
        if name.startswith(("postmill.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name}", name=name.removesuffix(".registry"))
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_nothing_else_imports_the_optional_parts():
    top = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(top, "postmill")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("/llm"):
                with open(os.path.join(folder, name)) as f:
                    text = f.read()
                    assert "postmill.llm" not in text and "corpus_pipeline" not in text, name
