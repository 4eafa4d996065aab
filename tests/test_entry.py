"""The entry without the optional folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
_ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 200; print(sum(n.startswith('op') or n == 'pipeline' for n in q))"


def _asked(folder: Path) -> int:
    return int(subprocess.run([sys.executable, "-c", _ASK], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True, timeout=300).stdout)


def test_queries_load_without_the_optional_folders(tmp_path):
    for name in ("strideframe", "__spark_entry__.py", "corpus_pipeline.py"):
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / name)
    assert _asked(tmp_path) == 0
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _asked(tmp_path) == 0
