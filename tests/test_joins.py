"""Everything over join trees: golden counts, random trees against the materialised join, checks, generators, JSON queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from treefold.functions import linalg
from treefold.operators import counts, decompose, factor, headtail, matrix, relational
from treefold.plans.query import Options, operator, run_query
from treefold.plans.tree import JoinTree, attributes_of, best_root, rooted_at
from treefold.sources import generators
from treefold.sources.relation import Attribute, Database, RelationSchema, random_relation, write_csv

KEYS = {
    "R1": (("X12", "X13"), [(1, 1), (1, 3), (2, 1), (2, 2), (3, 2), (3, 3)], 1),
    "R2": (("X12", "X24", "X25"), [(1, 1, 1), (1, 1, 3), (1, 2, 1), (1, 2, 3), (2, 2, 1), (2, 2, 2), (2, 3, 2), (3, 1, 2), (3, 1, 3), (3, 3, 2)], 1),
    "R5": (("X25",), [(1,), (1,), (1,), (2,), (3,), (3,)], 3),
    "R4": (("X24",), [(1,), (1,), (2,), (2,), (2,), (3,)], 3),
    "R3": (("X13",), [(1,), (2,), (2,), (3,), (3,), (3,)], 3),
}
SHAPE = ("R1", ("R2", "R5", "R4"), "R3")


def frame(spark, keys, rows, n, rng, name):
    columns = [*keys, *(f"Y{name[1:]}{i + 1}" for i in range(n))]
    return spark.createDataFrame([(*map(int, r), *map(float, rng.normal(size=n))) for r in rows], ", ".join(f"{c} {'long' if c in keys else 'double'}" for c in columns))


@pytest.fixture(scope="module")
def five(spark):
    rng = np.random.default_rng(0)
    return {n: frame(spark, k, rows, m, rng, n).persist() for n, (k, rows, m) in KEYS.items()}


def pairs(df, *names):
    return {tuple(r[:-1]) if len(names) > 2 else r[0]: r[-1] for r in df.select(*names).collect()}


def test_golden_counts(five):
    c = counts.all_counts(JoinTree(SHAPE, five))
    assert pairs(c["R4"].by_key, "X24", "down") == {1: 2, 2: 3, 3: 1}
    assert pairs(c["R4"].by_key, "X24", "circle") == {1: 35, 2: 32, 3: 8}
    assert pairs(c["R5"].by_parent, "X25", "up") == {1: 29, 2: 27, 3: 30}
    assert pairs(c["R3"].by_parent, "X13", "up") == {1: 38, 2: 20, 3: 32}
    assert pairs(c["R2"].by_parent, "X12", "pdown") == {1: 25, 2: 13, 3: 7}
    assert pairs(c["R2"].by_parent, "X12", "up") == {1: 4, 2: 3, 3: 5}
    assert pairs(c["R2"].by_key, "X12", "X24", "X25", "circle") == {(1, 1, 1): 24, (1, 1, 3): 16, (1, 2, 1): 36, (1, 2, 3): 24, (2, 2, 1): 27, (2, 2, 2): 9, (2, 3, 2): 3, (3, 1, 2): 10, (3, 1, 3): 20, (3, 3, 2): 5}
    assert pairs(c["R1"].by_key, "X12", "X13", "circle") == {(1, 1): 25, (1, 3): 75, (2, 1): 13, (2, 2): 26, (3, 2): 14, (3, 3): 21}
    assert counts.join_size(JoinTree(SHAPE, five)).first()[0] == 174


def dense(tree):
    return np.array(relational.materialise(tree).select(*tree.features).collect(), float)


def test_five_relations_all_ways(five):
    t = JoinTree(SHAPE, five)
    a = dense(t)
    want = linalg.upper(a)
    assert a.shape == (174, 11)
    assert np.allclose(decompose.upper_factor(t), want, atol=1e-10)
    assert np.allclose(decompose.upper_factor(t, "cofactor"), want, atol=1e-8)
    assert np.allclose(factor.upper_of_blocks(headtail.blocks(t, centred_tails=True), t.features), want, atol=1e-10)
    assert np.allclose(decompose.upper_factor(decompose.single(relational.materialise(t), features=t.features)), want, atol=1e-10)


def test_rows_of_a_join(five):
    t = JoinTree(("R2", "R5", "R4"), five)
    a = dense(t)
    q = decompose.qr(t, compute_q=True, method="cofactor").rows
    assert matrix.orthogonality(q, [f"q{i + 1}" for i in range(a.shape[1])]) < 1e-8
    scores = decompose.pca(t, percent=30, factor="cofactor")
    assert np.allclose(scores.sigma, np.linalg.svd(a, compute_uv=False))
    p = np.array(scores.rows.select("p1", "p2").collect(), float)
    assert np.allclose(np.linalg.norm(p, axis=0), scores.sigma[:2])
    rooted = JoinTree(rooted_at(("R2", "R5", "R4"), "R5"), five)
    assert np.allclose(np.linalg.svd(decompose.upper_factor(rooted, "cofactor"), compute_uv=False), scores.sigma)


def test_all_methods_give_one_factor(five, monkeypatch):
    t = JoinTree(("R2", "R5", "R4"), five)
    want = linalg.upper(dense(t))
    for method in ("heads_tails", "cofactor", "auto"):
        assert np.allclose(decompose.upper_factor(t, method), want, atol=1e-9)
    monkeypatch.setattr(decompose, "MOST_CONDITION", 0)
    assert np.allclose(decompose.upper_factor(t), want, atol=1e-10)
    monkeypatch.setattr(factor, "GENERATED_FIELDS", 5)
    assert np.allclose(decompose.upper_factor(t), want, atol=1e-10)
    f = decompose.qr(t, method="cholesky_qr2")
    assert np.allclose(f.r, want, atol=1e-10) and matrix.orthogonality(f.rows, [f"q{i + 1}" for i in range(len(want))]) < 1e-13


def test_centred_tails_take_no_window(five):
    t = JoinTree(SHAPE, five)
    for b in headtail.blocks(t, centred_tails=True):
        assert "Window" not in b.rows._jdf.queryExecution().optimizedPlan().toString()


def test_counts_beyond_doubles(spark):
    """Three children with 300,001-fold keys: circle counts above 2**53 to the last digit."""
    n = 300_001
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("k"))
    tree = JoinTree(("A", "B", "C"), {"A": rows.withColumn("a", F.lit(1.0)), "B": spark.range(300_001).select(F.lit(1).cast("bigint").alias("k"), F.lit(1.0).alias("b")), "C": spark.range(300_001).select(F.lit(1).cast("bigint").alias("k"), F.lit(1.0).alias("c"))})
    exact = counts.all_counts(tree)
    assert exact["B"].by_key.first()["circle"] == n * n
    assert counts.join_size(tree).first()[0] == n**3
    star = JoinTree(("A", "B", "C", "D"), {x: spark.range(n if x != "A" else 1).select(F.lit(1).cast("bigint").alias("k"), F.lit(1.0).alias(x.lower())) for x in "ABCD"})
    assert counts.all_counts(star)["A"].by_key.first()["circle"] == 27000270000900001
    odd = JoinTree(("A", "B", "C"), {x: spark.range(m).select(F.lit(1).cast("bigint").alias("k"), F.lit(1.0).alias(x.lower())) for x, m in (("A", 2), ("B", 300_001), ("C", 90_000_600_001 // 1_000_003))})
    assert counts.all_counts(odd)["A"].by_key.first()["circle"] == 300_001 * (90_000_600_001 // 1_000_003)
    inexact = counts.all_counts(tree, exact=False)
    assert inexact["B"].by_key.first()["circle"] == pytest.approx(float(n) ** 2, rel=1e-15)


def test_factors_of_many_partitions_are_merged_before_the_driver(spark, monkeypatch):
    """100 partitions and 4 shuffle partitions: four factors reach the driver, and R is right."""
    df = random_relation(spark, 3000, 3).drop("row").repartition(100).persist()
    seen = []
    monkeypatch.setattr(linalg, "upper", lambda a, n=None, upper=linalg.upper: seen.append(a.shape) or upper(a, n))
    got = factor.tsqr(df, df.columns)
    assert seen == [(4 * 3, 3)]
    monkeypatch.undo()
    assert np.allclose(got, linalg.upper(np.array(df.collect(), float)), atol=1e-10)


def test_rank_deficient_relations_and_joins(spark, five):
    """Cofactors fall back; LU gives zero pivots, and L times U is still the matrix."""
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(1, 40)], "x double, y double, z double")
    a = np.array(df.collect(), float)
    for method in ("cofactor", "auto", "heads_tails"):
        r = decompose.upper_factor(decompose.single(df), method)
        assert np.allclose(r.T @ r, a.T @ a, atol=1e-9)
    f = decompose.lu(decompose.single(df), compute_l=True)
    assert f.rank == 2 and f.pivot_columns == [0, 2] and not f.u[1].any()
    low = np.array(f.rows.select("l1", "l2", "l3").collect(), float)
    assert np.abs(low).max() <= 1 + 1e-12 and np.allclose(sorted(map(tuple, (low @ f.u).round(9))), sorted(map(tuple, a)), atol=1e-8)
    double = {**five, "R4": five["R4"].withColumn("extra", F.col("Y41") * 3)}
    t = JoinTree(("R2", "R5", "R4"), double)
    assert decompose.lu(t).rank == len(t.features) - 1
    assert decompose.lu(t).pivot_keys[0].keys() == {"X12", "X24", "X25"} - ({"X12"} if "X12" not in t.root.keys else set())


def test_concatenation(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, x double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k long, y double")
    assert sorted(map(tuple, matrix.beside(a, b, ["k"], 9.0).collect())) == [(1, 1.0, 9.0), (2, 2.0, 5.0), (3, 9.0, 6.0)]
    assert sorted(map(tuple, matrix.below(a, b).collect())) == [(1, 1.0, 0.0), (2, 0.0, 5.0), (2, 2.0, 0.0), (3, 0.0, 6.0)]
    with pytest.raises(ValueError, match="both sides"):
        matrix.beside(a, a, ["k"])
    with pytest.raises(ValueError, match="share no attribute"):
        relational.natural_join(a.select("x"), b.select("y"))


def test_lu_of_a_join(five):
    t = JoinTree(("R1", ("R2", "R5")), five, skip=["X13", "X24"])
    a = dense(t)
    u, rest, rows = [], a.copy(), a.tolist()
    for j in range(a.shape[1]):  # of rows with equal residuals the one with the larger values is the pivot
        at = max(range(len(a)), key=lambda i: (round(abs(rest[i, j]), 9), rest[i, j], rows[i]))
        u.append(rest[at].copy())
        rest = rest - np.outer(rest[:, j] / u[-1][j], u[-1])
    f = decompose.lu(t, compute_l=True)
    assert np.allclose(f.u, u, atol=1e-9)
    low = np.array(f.rows.select(*[f"l{i + 1}" for i in range(len(u))]).collect(), float)
    assert np.abs(low).max() <= 1 + 1e-9
    rows = sorted(map(tuple, np.round(low @ f.u, 8).tolist()))
    assert np.allclose(rows, sorted(map(tuple, np.round(a, 8).tolist())), atol=1e-7)


@pytest.mark.parametrize("seed", range(4))
def test_random_trees(spark, seed):
    """Composite keys, dangling rows, repeated rows, hot keys; factorised against materialised."""
    rng = np.random.default_rng(seed)
    n_keys = 1 + seed % 3
    k = [f"k{i}" for i in range(n_keys)]
    draw = lambda n, m: [tuple(rng.integers(0, 3, m)) for _ in range(n)]
    a = frame(spark, [*k, "z"], draw(25, n_keys + 1), 2, rng, "A1")
    b = frame(spark, k, draw(20, n_keys), 1, rng, "B2")
    c = frame(spark, ["z"], [(int(x),) for x in rng.integers(0, 4, 6)], 2, rng, "C3")
    b = b.unionAll(b.limit(5))
    t = JoinTree(("A", "B", "C"), {"A": a, "B": b.persist(), "C": c})
    d = dense(t)
    if len(d) < 6:
        return
    want = linalg.upper(d)
    assert np.allclose(decompose.upper_factor(t), want, atol=1e-9)
    assert np.allclose(decompose.upper_factor(t, "cofactor"), want, atol=1e-7)
    assert np.allclose(factor.factorised_gram(t), d.T @ d)
    reduced = relational.reduce_fully(t)
    assert np.allclose(dense(reduced).T @ dense(reduced), d.T @ d)
    assert counts.join_size(t).first()[0] == len(d)
    x = decompose.least_squares(t, t.features[2], "cofactor").coefficients
    at = 2
    rest = [i for i in range(d.shape[1]) if i != at]
    assert np.allclose(list(x.values()), np.linalg.lstsq(d[:, rest], d[:, at], rcond=None)[0])
    y = decompose.linear_regression(t, t.features[2], "cofactor").coefficients
    assert np.allclose(list(x.values()), list(y.values()))


def test_known_factor(spark):
    x, y, r = generators.known_factor_pair(spark, (40, 20), 4)
    assert np.allclose(decompose.upper_factor(JoinTree(("X", "Y"), {"X": x, "Y": y}))[:4, :4], r)


def test_empty_join(spark):
    a = spark.createDataFrame([(1, 1.0)], "k long, x double")
    b = spark.createDataFrame([(2, 1.0)], "k long, y double")
    t = JoinTree(("A", "B"), {"A": a, "B": b})
    assert np.array_equal(decompose.upper_factor(t), np.zeros((2, 2)))
    assert counts.join_size(t).first()[0] == 0


def test_tree_rules(spark):
    df = lambda s: spark.createDataFrame([], s)
    with pytest.raises(ValueError, match="shares no attribute"):
        JoinTree(("A", "B"), {"A": df("a long"), "B": df("b long")})
    with pytest.raises(ValueError, match="not connected"):
        JoinTree(("A", "B", ("D", "C")), {"A": df("k long, m long"), "B": df("k long, x double"), "D": df("m long, z long"), "C": df("z long, k long")})
    t = JoinTree(("A", "B"), {"A": df("k long, x double"), "B": df("k long, w double")})
    assert t.features == ["A__x", "B__w"] and t.root.parent_keys == ["k"]
    assert attributes_of(rooted_at(("A", ("B", "C")), "C")) == ["C", "B", "A"]
    frames = {"A": df("k long, x double"), "B": df("k long, w double")}
    assert best_root(("A", "B"), frames, {"A": 10, "B": 1000}) in (("A", "B"), ("B", "A"))


def test_one_hot_and_projection(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (2, 7, 3.0), (3, 9, 4.0)], "k long, c long, x double")
    assert relational.one_hot(df, ["c"]).columns == ["k", "c7", "c9", "x"]
    assert [tuple(r) for r in relational.one_hot(df, ["c"]).orderBy("k").collect()] == [(1, 0, 0, 2.0), (2, 1, 0, 3.0), (3, 0, 1, 4.0)]
    assert relational.drop_attributes(df, ["x", "nope"]).columns == ["k", "c"]
    assert relational.key_as_feature(df, ["k"]).columns == ["k", "c", "x", "kC"]
    assert relational.shrink_domain(df, "c", 2).select(F.max("c")).first()[0] < 2
    with pytest.raises(ValueError):
        relational.category_codes(df, "c", most=2)
    assert relational.shuffled(df).collect() == relational.shuffled(df.repartition(3)).collect()
    assert relational.alternate_features(["a", "b", "y", "c"], "y") == ["a", "c"]


def test_timers():
    from treefold.functions.timing import Timers

    t = Timers()
    for _ in range(3):
        with t.phase("a"):
            pass
    assert len(t.seconds["a"]) == 3 and t.means()["a"] >= 0


def test_matrix_operators(spark):
    a = spark.createDataFrame([(1, 2.0, 3.0), (4, 5.0, 6.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 8.0, 9.0), (4, 11.0, 12.0)], "k long, u double, w double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(matrix.add(a, b, ["k"])) == [(1, 10.0, 12.0), (4, 16.0, 18.0)]
    assert rows(matrix.subtract(a, b, ["k"])) == [(1, -6.0, -6.0), (4, -6.0, -6.0)]
    assert rows(matrix.multiply_diagonal(a, [2, 3], ["k"])) == [(1, 4.0, 9.0), (4, 10.0, 18.0)]
    m = spark.createDataFrame([(0.0, 1.0, 2.0), (3.0, 4.0, 5.0), (6.0, 7.0, 8.0)], "a double, b double, c double")
    assert rows(matrix.multiply(m, np.array([[0, 1], [2, 3], [4, 5]]))) == [(10.0, 13.0), (28.0, 40.0), (46.0, 67.0)]
    assert tuple(matrix.multiply_transpose(a, b, ["k"]).first()) == (71.0, 78.0, 90.0, 99.0)
    g = spark.createDataFrame([(1, 2, 2.0, 3.0), (1, 2, 4.0, 6.0), (1, 2, 6.0, 7.0)], "p long, q long, x double, y double")
    assert np.isclose(matrix.frobenius(g, ["p", "q"]).first()[0], 12.247448713916)
    assert np.allclose(factor.gram(g, ["x", "y"]), [[56, 72], [72, 94]])
    assert matrix.compare_factors(np.array([[-1.0, 2]]), np.array([[1.0, -2]]))[1]


def test_wide_gram_adds_up_in_partitions(spark):
    n = factor.WIDE + 2
    df = random_relation(spark, 50, n).drop("row").persist()
    a = np.array(df.collect(), float)
    assert np.allclose(factor.gram(df, df.columns), a.T @ a)
    assert np.allclose(factor.tsqr(df, df.columns), linalg.upper(a), atol=1e-9)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t1")
    write_csv(spark.createDataFrame([(1.0, 2.5)], "a double, b double"), path, precision=4)
    config = {"database": {"name": "d", "relations": [{"name": "T", "data_path": path, "primary_key": ["a"], "attributes": [{"name": "a", "type": "double"}, {"name": "b", "type": "float"}]}]}}
    db = Database.from_config(spark, json.dumps(config)).load_all()
    assert [tuple(r) for r in db.relations["T"].collect()] == [(1.0, 2.5)]
    db.rename("T", "U")
    assert db.copy("U") == "COPY_U" and db.size("COPY_U") == 1
    db.drop("U")
    db.drop_attributes(["b", "zz"])
    assert db.relations["COPY_U"].columns == ["a"] and db.report().count() == 1
    with pytest.raises(ValueError, match="unknown type"):
        Attribute("x", "text")
    with pytest.raises(ValueError, match="repeat"):
        RelationSchema("R", (Attribute("x"), Attribute("x")))
    again = Database.from_config(spark, db.config())
    assert list(again.schemas) == list(db.schemas) and db.memory_layout("row_major") is db
    tables = db.save_tables("saved_")
    assert db.load_table(tables[0], "V").count() == 1
    db.drop_tables(tables)
    a, b = generators.cartesian_pair(spark, (4, 3), (2, 2))
    assert relational.natural_join(a, b).count() == 12
    assert generators.keyed_product(spark, {"a": 2, "b": 3}).count() == 6


def test_json_queries(spark, five):
    db = Database(spark)
    for n, df in five.items():
        db.add(n, df)
    leaf = lambda n: {"operator": "relation", "relation": n}
    tree = {"operator": "natural_join", "central_relation": leaf("R1"), "children": [{"operator": "natural_join", "central_relation": leaf("R2"), "children": [leaf("R5"), leaf("R4")]}, leaf("R3")]}
    ask = lambda op, **more: run_query(db, {"query": {"name": "q", "expression": "", "evaluation_hint": {"operator": op, "operands": [tree], **more}}}, Options(aliases=("JOIN",)))
    assert ask("eval_join").count() == 174
    assert ask("QR_JOIN", skip_attributes=["Y51"]).r.shape == (10, 10)
    assert ask("SVD_JOIN").sigma.shape == (11,)
    assert set(ask("LIN_REG", label_name="Y11").coefficients) == set(ask("LLS_QR", label_name="Y11").coefficients)
    run_query(db, json.dumps({"query": {"evaluation_hint": {"operator": "assign", "name": "J", "operands": [tree]}}}))
    assert spark.table("J").count() == 174
    with pytest.raises(ValueError, match="preorder"):
        ask("QR_JOIN", relation_order=["R2", "R1", "R5", "R4", "R3"])
    assert ask("QR_TREE", root="best").r.shape == (11, 11)
    for bad in ("GIV_QR", "QR_", "FOO", "QR_9", "QR_HOUSHOLDER", "LIN_REG_X"):
        with pytest.raises(ValueError, match="unknown operator"):
            operator(bad)
    assert operator("PCA_EIGEN_DECOMP") == ("pca", "eigen") and operator("LIN_REG_TREE") == ("lls", "") and operator("QR_X", ["X"]) == ("qr", "")


def test_streaming_factor(spark, tmp_path):
    from treefold.streaming.incremental import StreamingFactor

    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 3))
    src = str(tmp_path / "in")
    for part in (a[:25], a[25:]):
        spark.createDataFrame([tuple(map(float, r)) for r in part], "x double, y double, z double").coalesce(1).write.mode("append").parquet(src)
    f = StreamingFactor(["x", "y", "z"])
    stream = spark.readStream.schema("x double, y double, z double").option("maxFilesPerTrigger", 1).parquet(src)
    f.start(stream, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert np.allclose(f.r, linalg.upper(a), atol=1e-10)
