"""The driver's entry points, with and without the training-data operators."""

import importlib
import sys

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["split_no", "auc", "tpr_at_fpr"] and df.count() == 6


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("privaudit.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "privaudit.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr(sys.modules["privaudit"], "llm", raising=False)
    entry = importlib.reload(__spark_entry__)
    names = entry.queries()
    assert "audit_minimal" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
