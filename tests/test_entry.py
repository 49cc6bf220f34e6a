"""The driver contract, with and without optional parts."""

import sys

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "daily_coverage" in entry.queries()


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "date" in df.columns


def test_works_without_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("nimbara.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "nimbara.llm", None)
    names = entry.queries()
    assert "daily_coverage" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
