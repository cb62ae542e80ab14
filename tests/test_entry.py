import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["query_id", "query_session", "rank"] and df.count() == 2500


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["candidate_pairs_topk", "overlap_groups", "longitudinal_baseline", "identity_audit", "registry_replay", "posture_summary"])
def test_queries_match_their_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, small)
    sql = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(got.columns)
    text = lambda row: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(text(r[c] for c in columns) for r in got.collect()) == sorted(map(text, sql.fetchall()))


def test_imports_without_the_corpus_folders(tmp_path):
    """A full copy without the two folders, the pipeline's file left behind: queries, oracles and the other tests import."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db"))
    shutil.rmtree(copy / "trackloom" / "llm"), shutil.rmtree(copy / "tests" / "llm")
    assert (copy / "corpus_pipeline.py").exists()
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n == 'pipeline' or n.startswith('op') and n[2].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=own)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-1] == "[]" and int(out.stdout.split()[0]) > 70
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, capture_output=True, text=True, env=own)
    assert out.returncode == 0, out.stdout + out.stderr


def test_the_subpackage_is_named_nowhere_else():
    for path in (ROOT / "trackloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "trackloom.llm" not in path.read_text(), path
    assert importlib.util.find_spec("trackloom.plans.registry")
