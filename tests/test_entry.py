"""The entry point without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_training_data_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for leave in (True, False):
        if not leave and (tmp_path / "repo" / "corpus_pipeline.py").exists():
            os.remove(tmp_path / "repo" / "corpus_pipeline.py")
        code = "import __spark_entry__ as e; import bench; q = e.queries(); assert q and set(e.oracle_sql()) == set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
