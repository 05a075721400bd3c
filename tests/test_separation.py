"""The library without the training-data subpackage: the entry still imports and gives the other queries."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_subpackage(tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(f"{REPO}/evbench", root / "evbench", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", root / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
