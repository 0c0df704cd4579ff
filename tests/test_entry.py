"""The entry module, with the training-data operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def names(folder: str) -> set[str]:
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env=environment, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def copy(to, *without: str) -> str:
    shutil.copytree(ROOT, to, ignore=lambda folder, found: [x for x in found if x in (".git", "__pycache__", ".pytest_cache") or os.path.relpath(os.path.join(folder, x), ROOT) in without])
    return str(to)


@pytest.mark.parametrize("gone", [("tracewell/llm", "tests/llm"), ("tracewell/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_training_data_operators(tmp_path, gone):
    found = names(copy(tmp_path / "repo", *gone))
    assert "fingerprint_clusters" in found and not any(x.startswith("op") or x == "pipeline" for x in found)


def test_an_error_inside_the_operators_is_not_swallowed(tmp_path):
    folder = copy(tmp_path / "repo")
    broken = os.path.join(folder, "tracewell", "llm", "queries.py")
    if not os.path.exists(broken):
        pytest.skip("the operators are not there")
    with open(broken, "w") as file:
        file.write("import no_such_module\n")
    with pytest.raises(AssertionError, match="no_such_module"):
        names(folder)
