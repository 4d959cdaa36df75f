import pytest
from compare import database, rows

from loomlake.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(db.sql(ORACLES[name]).df())


def test_every_query_is_checked_somewhere():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs_without_the_optional_subpackage(spark, monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("loomlake.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loomlake.llm", None)
    module = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    assert set(module.queries()) == set(QUERIES)
    assert module.entry(spark).count() > 0
