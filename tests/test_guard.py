"""The library and the other queries work without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_without_subpackage(tmp_path):
    import shutil

    shutil.copytree(REPO / "sparklog", tmp_path / "sparklog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); import sparklog.cli"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_it():
    for p in (REPO / "sparklog").rglob("*.py"):
        if "llm" not in p.parts:
            assert "sparklog.llm" not in p.read_text(), p
