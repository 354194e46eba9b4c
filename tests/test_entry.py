"""The entry with and without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_training_data(tmp_path, with_pipeline):
    """The registered queries of the rest stay when the subpackage is left out, whether the pipeline file is there or not."""
    ignored = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=ignored)
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path / name)
    code = (
        "import sys, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
        "assert len(q) > 70 and set(s) <= set(q), (len(q), set(s) - set(q)); "
        "assert 'pipeline' not in q and not [m for m in sys.modules if m.startswith('tidemark.llm')]"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
