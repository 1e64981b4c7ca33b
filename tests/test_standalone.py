"""The library without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e, bench; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert set(e.oracle_sql()) <= set(q); print('fine', len(q))"


def test_entry_without_the_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for pipeline in (True, False):
        if not pipeline:
            os.remove(tmp_path / "r" / "corpus_pipeline.py")
        got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0 and "fine" in got.stdout, got.stderr[-2000:]
