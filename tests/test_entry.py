import importlib
import sys

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "o_orderdate", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    got = importlib.reload(entry)
    try:
        assert "tpch_q3_plain" in got.queries() and not any(k.startswith("op") for k in got.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
