"""The entry works without the corpus subpackage, without its libraries, and without the pipeline."""

import pathlib
import shutil
import subprocess
import sys

import pytest

from marlstone.plans import catalogue

ROOT = pathlib.Path(__file__).parents[1]
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(folder, first: str = "") -> list[set[str]]:
    said = subprocess.run([sys.executable, "-c", first + ASK], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [set(line.split()) for line in said.splitlines()]


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    assert names(tmp_path) == [set(catalogue.QUERIES), set(catalogue.ORACLE_SQL)]


def test_without_a_library_of_the_corpus_subpackage():
    hide = "import sys; sys.modules['xxhash'] = None; "
    assert names(ROOT, hide) == [set(catalogue.QUERIES), set(catalogue.ORACLE_SQL)]
