"""Joins in which one key makes millions of rows of little input: the rows are whole and no task makes most of them."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from treefold.operators import decompose, gridjoin, relational, rightmul
from treefold.plans.tree import JoinTree

#: Queries with a row for each row of the join.
SPREAD = ["lu_l_factorized", "pca_half", "pca_scores_eigen_dc", "pca_scores_factorized", "pca_scores_qr_iter", "svd_u", "pca_scores_divide_conquer", "pca_scores_eigen_qr", "pca_scores_power", "qr_q_factorized", "pca_scores_eigen", "pca_scores_eigen_rrr", "pca_scores_qr"]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One nation with 3,000 customers and 3,000 suppliers."""
    home = str(tmp_path_factory.mktemp("hot"))
    value = lambda n: (F.xxhash64("id", F.lit(n)) % 100_000 / 100).alias
    spark.range(1, numPartitions=1).select(F.lit(7).alias("n_nationkey"), F.lit(1).alias("n_regionkey")).write.parquet(f"{home}/nation.parquet")
    spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("c_custkey"), F.lit(7).alias("c_nationkey"), value(1)("c_acctbal")).write.parquet(f"{home}/customer.parquet")
    spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("s_suppkey"), F.lit(7).alias("s_nationkey"), value(2)("s_acctbal")).write.parquet(f"{home}/supplier.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield home
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", SPREAD)
def test_no_task_makes_most_rows(spark, hot, name):
    made = [r["count"] for r in e.queries()[name](spark, hot).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(made) == 9_000_000 and max(made) < 5_000_000


#: Queries of which the files were measured.
SMALL = ["pca_scores_eigen", "pca_scores_divide_conquer", "pca_scores_eigen_qr", "pca_scores_power", "pca_scores_eigen_rrr", "pca_scores_factorized", "pca_scores_qr", "pca_scores_eigen_dc", "pca_scores_qr_iter"]


@pytest.fixture(scope="module")
def alike(spark, hot, tmp_path_factory):
    """One nation with 30 times 100 customers and 30 times 100 suppliers: 10,000 different rows, each 900 times."""
    home = str(tmp_path_factory.mktemp("alike"))
    for name, value in (("customer", "c_acctbal"), ("supplier", "s_acctbal")):
        df = spark.read.parquet(f"{hot}/{name}.parquet")
        df.withColumn(value, F.xxhash64(F.col(df.columns[0]) % 100, F.lit(value)) % 100_000 / 100).coalesce(1).write.parquet(f"{home}/{name}.parquet")
    spark.read.parquet(f"{hot}/nation.parquet").write.parquet(f"{home}/nation.parquet")
    return home


@pytest.mark.parametrize("name", SMALL)
def test_equal_rows_take_little_disk(spark, alike, tmp_path, name):
    """Equal rows come one after the other, so that files hold each of them once."""
    e.queries()[name](spark, alike).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("p1", "p2").count()
    assert rows.agg(F.count("*"), F.min("count"), F.max("count")).first() == (10_000, 900, 900)
    assert sum(p.stat().st_size for p in Path(tmp_path, "out").glob("*.parquet")) < 1_000_000


@pytest.mark.parametrize("cell,run,stretch", [(1, 2, 1), (2, 3, 2), (1000, 64, 4096)])
def test_runs_give_the_rows_of_the_join(spark, monkeypatch, cell, run, stretch):
    """Rows alike more and less often than a run is long, with nulls, NaN and keys on one side only."""
    monkeypatch.setattr(gridjoin, "CELL", cell)
    monkeypatch.setattr(gridjoin, "RUN", run)
    monkeypatch.setattr(gridjoin._runs, "__defaults__", (stretch,))
    a = spark.createDataFrame([(1, 0.5)] * 7 + [(1, float("nan"))] * 2 + [(2, None)] * 5 + [(3, 1.0), (None, 1.0)], "k long, x double")
    b = spark.createDataFrame([(1, 1.5)] * 4 + [(1, None), (2, -1.0), (2, 3.0), (2, 3.0), (4, 1.0)], "k long, y double")
    cells = spark.createDataFrame([(1, 3, 2)], "k long, __a long, __b long")
    assert gridjoin._runs(a, stretch).agg(F.sum("__n"), F.max("__n")).first() == (16, min(run, 7))
    got = gridjoin.grid_join(a, b, ["k"], gridjoin.Grid(F.broadcast(cells), 4))
    plain = lambda df: Counter(str(tuple(r)) for r in df.collect())
    assert plain(got) == plain(a.join(b, "k")) and got.columns == ["k", "x", "y"]


def test_grid_gives_the_rows_of_the_join(spark, monkeypatch):
    """Cells of one row, with equal rows, keys on one side only, nulls and a third relation above."""
    monkeypatch.setattr(gridjoin, "CELL", 1)
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, None), (2, 2.0), (2, 2.0), (4, 1.0), (None, 1.0)], "k long, x double")
    c = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (2, 3.0), (2, 4.0), (3, 1.0)], "k long, y double")
    tree = JoinTree(("a", "b", "c"), {"a": a, "b": b, "c": c})
    found = gridjoin.grids(tree)
    assert set(found) == {"b", "c"}
    ab = gridjoin.grid_join(a, b, ["k"], found["b"])
    got = gridjoin.grid_join(ab, c, ["k"], found["c"])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, a.join(b, "k").join(c, "k").collect()))


@pytest.mark.parametrize("order", [["a", "b", "c"], ["b", "c", "a"], ["c", "a", "b"], ["b", "a"]])
def test_top_fraction_is_the_sorted_end(spark, monkeypatch, order):
    """Against a sort, with nulls, NaN and ties, and with more values than the driver takes."""
    monkeypatch.setattr(relational, "MOST_VALUES", 50, raising=False)
    rows = [(i % 3 or None, [float("nan"), None, float(i % 7), i * 0.25][i % 4], f"t{i * 7 % 90}") for i in range(600)] * 2
    df = spark.createDataFrame(rows, "a long, b double, c string").select(*order)
    sorted_rows = [str(tuple(r)) for r in df.orderBy(*[F.col(c).desc() for c in order]).collect()]
    for fraction in (0.0, 0.05, 0.6, 1.0):
        got = relational.top_fraction(df, fraction)
        assert Counter(str(tuple(r)) for r in got.collect()) == Counter(sorted_rows[: int(1200 * fraction)])
        assert "TakeOrdered" not in got._jdf.queryExecution().toString()  # it holds its limit in memory


def test_reduce_to_top_holds_no_rows(spark, hot):
    top = e.queries()["reduce_to_top"](spark, hot)
    assert "TakeOrdered" not in top._jdf.queryExecution().toString() and 140 <= top.count() <= 300


def test_top_of_a_join_is_whole(spark, hot):
    assert e.queries()["top_fraction_join"](spark, hot).count() == 450_000


@pytest.mark.parametrize("order", [None, ["a"]])
def test_equal_rows_at_the_end_of_the_top_pass_no_single_task(spark, order):
    """Rows alike are written out, not read again and cut in one task; rows that the order leaves open are still cut."""
    rows = [(1, float("nan"), "x")] * 700 + [(1, None, "y")] * 200 + [(None, 0.5, "z")] * 100
    df = spark.createDataFrame(rows, "a long, b double, c string")
    for fraction in (0.05, 0.7, 0.75, 0.95):
        top = relational.top_fraction(df, fraction, order)
        assert top.count() == 1000 * fraction and (order or not top.subtract(df).count())
        assert top.schema == df.schema and (order or "Limit" not in top._jdf.queryExecution().toString())


def test_top_of_a_join_holds_no_rows(spark, hot):
    top = e.queries()["top_fraction_join"](spark, hot)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in top and "Limit" not in top


def test_extreme_of_rows_takes_no_structs_of_all_rows(spark, monkeypatch):
    """Both signs, ties to the larger row; only rows that reach the extreme are compared as rows."""
    tree = decompose.single(spark.createDataFrame([(-3.0, 1.0), (3.0, 2.0), (3.0, 5.0), (1.0, 9.0), (None, 1.0)], "x double, y double"))
    structs = []
    whole = F.struct
    monkeypatch.setattr(rightmul.F, "struct", lambda *c: structs.append(len(c)) or whole(*c))
    assert rightmul.extreme_row(tree, np.array([1.0, 0.0]))[0].tolist() == [3.0, 5.0]
    assert rightmul.extreme_row(tree, np.array([0.0, -1.0]))[0].tolist() == [1.0, 9.0]
    assert rightmul.extreme_row(tree, np.array([-1.0, 0.0]))[0].tolist() == [-3.0, 1.0]
    assert structs == [2, 2, 2]
