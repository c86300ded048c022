"""The driver contract without the training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from verdance import session

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("folders", [("verdance/llm", "tests/llm"), ("verdance/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_part(tmp_path, folders):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(f).name for f in folders)))
    assert not (copy / "verdance/llm").exists()
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, oracles, training = map(int, done.stdout.split())
    assert n >= oracles > 100 and training == 0
    code = [p.read_text() for p in (copy / "verdance").rglob("*.py")]
    assert not any("verdance.llm" in text for text in code)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.checkpoint_dir(Session())
