"""The driver contract."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns and found.limit(1).count() == 1


def test_sql_names_are_query_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_operators():
    """With the subpackage out of reach, the entry still imports and offers the other queries."""
    code = "import sys; sys.modules['factloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(e.queries()) and not any(n.startswith('op1') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "factloom.llm" not in path.read_text(), path
