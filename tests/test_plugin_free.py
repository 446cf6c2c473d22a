"""The library stands without the training-data subpackage."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "corpusloom").parts:
            assert not re.search(r"^\s*(from|import)\s+\S*llm", p.read_text(), re.M), p


def test_entry_without_it():
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("corpusloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "repetition_signals" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
