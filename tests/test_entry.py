import importlib
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quern import queries_index, queries_store
from quern.queries import NAMES as FIRST

NAMES = [*FIRST, *queries_store.NAMES, *queries_index.NAMES]

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
have_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_names():
    assert set(NAMES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@have_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(row):
    return tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in row)


@have_tables
@pytest.mark.parametrize("name", ["hybrid_search", "chunk_windows", "bm25_topk", "related_docs", "url_normalize", "import_counts", "job_metrics", "documents_upsert", "cluster_summary", "eval_means", *(n for n in queries_index.NAMES if n not in ("vector_cells", "knn_descent", "rebuilt_topics", "manual_bookmark")), *(n for n in queries_store.NAMES if n not in ("worked_jobs", "worked_search"))])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, cur.fetchall()))


def test_works_without_the_llm_folders(tmp_path):
    """The engine imports and names its queries when the subpackage llm and the pipeline are deleted."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run(["cp", "-r", f"{root}/quern", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quern" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(NAMES)), "False"], out.stderr


def test_no_part_of_the_engine_imports_llm():
    importlib.import_module("quern.engine")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(f"{root}/quern"):
        if not folder.endswith("/llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in [w for line in open(f"{folder}/{f}") if "import" in line for w in line.replace(".", " ").split()], f
