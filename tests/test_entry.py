from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["thread_id", "seq", "label", "text", "n_messages"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_missing_modules_are_forgiven(monkeypatch):
    import importlib

    def missing(name):
        def load(_):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    for name in ("skein.llm", "skein.llm.queries", "corpus_pipeline", "tiktoken"):
        monkeypatch.setattr(importlib, "import_module", missing(name))
        assert entry._llm() is None and "replay_history" in entry.queries()
    monkeypatch.setattr(importlib, "import_module", missing("skein.llm.misspelt"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_queries_are_named_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(entry.queries())), str(len(entry.oracle_sql()))]
