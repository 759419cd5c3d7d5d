"""The registry works with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"


def counts(folder):
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_queries_without_the_subpackage(tmp_path):
    for part in ("stratagraph", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (ROOT / part).is_dir() else shutil.copy
        if (ROOT / part).exists():
            copy(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "stratagraph" / "llm", ignore_errors=True)
    there, alone = counts(ROOT), counts(tmp_path)
    assert alone[2] == 0 and alone[0] == there[0] - there[2] > 90
