"""The driver's contract: the entry loads without a session, from any folder, and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), len([n for n in q if n.startswith('op')]))"


def asked(root: Path, folder: Path) -> list[int]:
    env = os.environ | {"PYTHONPATH": str(root)}
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()]


def copied(tmp_path: Path) -> Path:
    root = tmp_path / "copy"
    root.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", root)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", root)
    shutil.copytree(ROOT / "quillon", root / "quillon", ignore=shutil.ignore_patterns("__pycache__"))
    return root


def test_queries_load_without_a_session(tmp_path):
    n, _ = asked(ROOT, tmp_path)
    assert n > 90


def test_the_rest_loads_without_the_subpackage(tmp_path):
    root = copied(tmp_path)
    shutil.rmtree(root / "quillon" / "llm", ignore_errors=True)
    n, ops = asked(root, tmp_path)
    assert n > 90 and ops == 0
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    assert asked(root, tmp_path) == [n, 0]
