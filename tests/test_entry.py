import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_entry_stands_without_the_training_data_part(tmp_path):
    """With its folders deleted (and with or without the pipeline beside them) the other queries still import."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (copy / name).unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
