"""The entry points without the training-data part, and with a part of it broken."""

from __future__ import annotations

import builtins
import sys

import pytest

import __spark_entry__ as entry


def test_the_rest_works_without_the_training_data_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpusloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpusloom.llm.queries", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    names = set(entry.queries())
    assert "rag_pipeline" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= names


def test_broken_parts_are_not_hidden(monkeypatch):
    real = builtins.__import__

    def broken(name, *args, **more):
        if name in ("corpusloom.llm", "corpus_pipeline"):
            raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError, match="numpy"):
        entry.queries()
