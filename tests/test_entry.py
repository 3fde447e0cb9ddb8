"""The entry module with and without the optional operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; from geoscore.workload.queries import QUERIES; print(set(e.queries()) == set(QUERIES))"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_library_without_optional_operators(tmp_path, gone):
    """The library's own queries are all that is left, and they import."""
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "geoscore", tmp_path / "geoscore", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone:
            shutil.copy(ROOT / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr
