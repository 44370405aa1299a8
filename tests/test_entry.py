import sys

import __spark_entry__ as entry


def test_without_the_operators_for_training_data(monkeypatch):
    monkeypatch.setitem(sys.modules, "cutline.llm.queries", None)
    found = entry.queries()
    assert set(entry.oracle_sql()) == set(found) and "projection" in found and "pipeline" not in found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
