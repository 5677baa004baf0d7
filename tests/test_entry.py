"""The entry module with and without the optional training-data queries."""

import os
import shutil
import subprocess
import sys

REPO = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")


def names(folder):
    text = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", text], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in out.stdout.splitlines()[-2:]]


def test_without_the_optional_package(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    rounds = 0
    while rounds == 0 or (copy / "corpus_pipeline.py").exists():  # the driver may leave that file or take it away
        if rounds:
            (copy / "corpus_pipeline.py").unlink()
        queries, sql = names(copy)
        assert "a06_stage_histogram" in queries and sql <= queries
        assert not {n for n in queries if n.startswith("op") or n == "pipeline"}
        rounds += 1
