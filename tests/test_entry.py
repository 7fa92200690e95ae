"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["region", "iso_week", "net_revenue"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_can_be_listed_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 100


def test_works_without_the_corpus_operators(tmp_path):
    """Only the rest of the package is copied: it must import, and list its own queries."""
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert "kpi_net_revenue" in out.stdout and "op1_" not in out.stdout and "pipeline" not in out.stdout


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "tidemark").parts:
            assert "tidemark.llm" not in f.read_text()
