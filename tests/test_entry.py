import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from gleaner import session

REPO = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_core_stands_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO / "gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    (tmp_path / "gleaner/llm/__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_core_stands_without_what_the_training_data_part_needs(tmp_path):
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(REPO)})


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Session:
        sparkContext = Context()
        conf = {}

    session.ship.done = "x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_nothing_else_imports_it():
    for f in (REPO / "gleaner").rglob("*.py"):
        if "llm" not in f.parts:
            assert "gleaner.llm" not in f.read_text(), f
