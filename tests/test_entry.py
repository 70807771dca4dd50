"""The registry, and the catalogue against its own SQL on the small tables where those are present."""

import glob
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 70


def test_library_stands_without_the_text_operators(tmp_path):
    """A copy without treefold/llm and the pipeline still imports and lists the other queries."""
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert e.oracle_sql(); print(len(e.queries()))"
    for name in ("__spark_entry__.py", "treefold"):
        os.system(f"cp -r {ROOT}/{name} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/treefold/llm")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


SOME = ["full_reducer_orders", "circle_counts", "qr_tails", "gen_tails", "block_union", "gram_factorized", "qr_r_deep", "qr_q_factorized", "svd_u", "pca_scores_power", "lls_qr", "lu_l_factorized"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = e.queries()[name](spark, DATA).toPandas(), con.sql(e.oracle_sql()[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(float).round(6).to_numpy().tolist()))
    for a, b in zip(rows(got), rows(want)):
        assert a == pytest.approx(b, abs=2e-6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 25 and all(r["value"] >= 0 for r in rows if r["i"] == r["j"])
