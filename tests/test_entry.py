import importlib
import sys

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("missing", ["stratacube.llm", "stratacube.llm.queries", "ahocorasick"])
def test_cube_queries_stand_by_themselves(monkeypatch, missing):
    """With the text subpackage gone, or with a package that only it needs."""
    for name in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("stratacube.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises ImportError
    e = importlib.import_module("__spark_entry__")
    assert "event_code_share" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert not any(k == "pipeline" or k[2:3].isdigit() for k in e.queries())
