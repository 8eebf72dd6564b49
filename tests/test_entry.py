"""The entry module, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from inkwell.plans import proxies

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["page_id", "text"] and out.count() == 50


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(proxies.SQL) == set(proxies.QUERIES)


@pytest.mark.parametrize("more", [["corpus_pipeline.py"], []])
def test_stands_without_the_training_data_operators(tmp_path, more):
    skip = shutil.ignore_patterns("llm", *more, ".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    (tmp_path / "repo" / "inkwell" / "llm" / "__pycache__").mkdir(parents=True)  # what deleted code may leave
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True)
    assert said.stdout.split() == sorted(proxies.QUERIES) * 2


@pytest.mark.skipif(not os.path.isfile(os.path.join(REPO, "inkwell", "llm", "queries.py")), reason="they are left out")
@pytest.mark.parametrize(("code", "seen"), [("import inkwell.no_such_module", True), ("raise ValueError('no_such_module')", True), ("from inkwell.llm.shared import no_such_module", True), ("import no_such_module", False)])
def test_what_fails_inside_them_is_seen(tmp_path, code, seen):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    (tmp_path / "repo" / "inkwell" / "llm" / "queries.py").write_text(code + "\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=False)
    assert bool(said.returncode) == seen and ("no_such_module" in said.stderr) == seen
    assert seen or said.stdout.split() == [str(len(proxies.QUERIES))]


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(REPO, "inkwell")):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    assert "inkwell.llm" not in file.read()
