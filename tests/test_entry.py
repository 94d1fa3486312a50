"""The registry: it works, also without the llm subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "tesselix", tmp_path / "tesselix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, *rest = said.stdout.split()
    assert int(n) > 30 and rest == ["False", "False"]


def test_nothing_else_imports_llm():
    for f in (ROOT / "tesselix").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "tesselix.llm" not in f.read_text()
