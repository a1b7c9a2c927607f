"""The driver's contract, with and without the corpus operators."""

import importlib
import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("corpus_pipeline.py",), ()])
def test_the_rest_stands_alone(tmp_path, gone):
    """Without the subpackage, and the pipeline with it or not, the module imports and has the other queries."""
    for p in ROOT.iterdir():
        if p.name in ("lodestone", ".git", *gone):
            continue
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "lodestone").mkdir()
    for p in (ROOT / "lodestone").iterdir():
        if p.name != "llm":
            (tmp_path / "lodestone" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lodestone.llm" not in p.read_text()
