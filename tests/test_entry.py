"""The driver contract holds with the training-data part and without it."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder: Path) -> list[list[str]]:
    said = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return json.loads(said.stdout)


def copied(to: Path, *without: str) -> Path:
    skipped = {str(ROOT / w) for w in without}
    shutil.copytree(ROOT, to, ignore=lambda at, found: [n for n in found if str(Path(at) / n) in skipped or n in (".git", "__pycache__")])
    return to


@pytest.mark.parametrize("without", [("quaywork/llm", "tests/llm", "corpus_pipeline.py"), ("quaywork/llm", "tests/llm")])
def test_the_rest_works_alone(tmp_path, without):
    found, sql = names(copied(tmp_path / "repo", *without))
    assert found and set(sql) <= set(found) and not [n for n in found if n == "pipeline" or n.startswith("op")]
    kept = [p for p in (tmp_path / "repo").rglob("*.py") if "quaywork.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
    assert {p.name for p in kept} <= {"__spark_entry__.py", "corpus_pipeline.py", "test_entry.py"}


def test_other_missing_modules_are_errors(tmp_path):
    folder = copied(tmp_path / "repo", "quaywork/operators/metrics.py")
    with pytest.raises(AssertionError, match="quaywork.operators"):
        names(folder)
