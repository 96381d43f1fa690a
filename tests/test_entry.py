"""The entry works with and without the training-data operators."""

import json
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder) -> list[list[str]]:
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return json.loads(out.stdout.splitlines()[-1])


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    gone = {"llm", ".git", "__pycache__"} | (set() if with_pipeline else {"corpus_pipeline.py"})
    shutil.copytree(REPO, tmp_path / "copy", ignore=lambda _, found: [f for f in found if f in gone])
    keys, oracles = names(tmp_path / "copy")
    assert len(keys) >= 59 and oracles
    assert "pipeline" not in keys and not [k for k in keys if k.startswith("op") and k[2:3].isdigit()]
