"""The entry module with and without the training-data parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), len(e.LLM_QUERIES))"


def copied(folder, *left_out):
    skipped = {os.path.join(REPO, part) for part in (".git", *left_out)}

    def skip(parent, names):
        return [n for n in names if os.path.join(parent, n) in skipped or n in ("__pycache__", ".pytest_cache")]

    return shutil.copytree(REPO, folder / "repo", ignore=skip)


def imported(repo, say=SAY):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p and os.path.abspath(p) != REPO)}
    return subprocess.run([sys.executable, "-c", say], cwd=repo, env=env, capture_output=True, text=True)


@pytest.mark.parametrize("left_out", [["accesslens/llm", "tests/llm"], ["accesslens/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_without_the_training_data_parts(tmp_path, left_out):
    done = imported(copied(tmp_path, *left_out))
    assert done.returncode == 0, done.stderr
    queries, oracles, llm = map(int, done.stdout.split())
    assert llm == 0 and queries >= oracles > 70


def test_other_missing_modules_are_errors(tmp_path):
    done = imported(copied(tmp_path, "accesslens/session.py"))
    assert done.returncode != 0 and "accesslens.session" in done.stderr
