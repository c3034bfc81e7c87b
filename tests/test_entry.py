from __future__ import annotations

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_works_without_the_training_data_package(tmp_path):
    shutil.copytree(f"{ROOT}/telespark", tmp_path / "telespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'red_buckets' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_that_package():
    found = subprocess.run(["grep", "-rlE", r"telespark\.llm|telespark import llm", f"{ROOT}/telespark", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/telespark/llm/" in f for f in found)
