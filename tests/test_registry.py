import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from shelfspark.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def canonical(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert canonical(got) == canonical(wanted)


def test_entry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_long_library_paths_stay_whole(spark, monkeypatch):
    path = "/reader/" + "a" * 12_000 + ".cbz"
    rows = spark.createDataFrame([(1, path)], "request_id long, path string")
    monkeypatch.setattr(registry.Tables, "requests", lambda self: rows)
    assert registry.QUERIES["x18_audit_target"](spark, SMALL).collect()[0]["target_path"] == path


@pytest.mark.parametrize("gone", [["shelfspark/llm"], ["shelfspark/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without_the_llm_subpackage(tmp_path, gone):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{top}/shelfspark", tmp_path / "shelfspark", ignore=lambda folder, names: [n for n in names if n == "__pycache__" or os.path.relpath(f"{folder}/{n}", top) in gone])
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        if os.path.exists(f"{top}/{name}"):
            shutil.copy(f"{top}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES), len(e.oracle_sql()) == len(e.registry.ORACLES))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split() == ["True", "True"]
