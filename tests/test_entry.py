from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_queries_without_the_subpackage(tmp_path):
    """With the llm folder gone, the rest still lists its queries, also where corpus_pipeline.py is left."""
    shutil.copytree(ROOT / "lexigrid", tmp_path / "lexigrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import lexigrid.llm.common\n")
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = set(done.stdout.split())
    assert names and names == {n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")}


def test_every_twin_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
