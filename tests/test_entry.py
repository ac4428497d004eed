import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_core_query_has_an_oracle():
    from sluice import queries

    assert set(queries.queries()) == set(queries.oracle_sql()) and "dashboard" in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["machine", "status", "order_no", "since"]


def test_core_imports_nothing_of_the_subpackage():
    for path in (ROOT / "sluice").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"sluice\.llm|corpus_pipeline", path.read_text()), path


def test_entry_without_the_subpackage(tmp_path):
    for path in ROOT.rglob("*.py"):
        to = tmp_path / path.relative_to(ROOT)
        if "llm" not in path.relative_to(ROOT).parts and path.name != "corpus_pipeline.py":
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(path.read_text())
    code = "import __spark_entry__ as e; n = e.queries(); e.oracle_sql(); assert 'dashboard' in n and not any(k.startswith('op') for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
