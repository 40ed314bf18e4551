"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("arcloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "flagship_two_hop" in e.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["score"] >= rows[-1]["score"]


def test_oracles_have_queries():
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_works_without_llm():
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).resolve().parent / "arcloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "arcloom.llm" not in f.read_text(), f
