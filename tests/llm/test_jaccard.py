"""Near-dedup by Jaccard similarity against all pairs, on edited copies, null ids and shared ids."""

import collections
import random

import numpy as np
import pytest

from .test_text_operators import SCHEMA, order


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def slow_groups(texts):
    """Index -> least index that a chain of similar texts reaches."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.fixture(scope="module")
def edited():
    """Texts of 300 words and copies with 1 to 6 words replaced."""
    rng = random.Random(3)
    out = []
    for b in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        out.append(" ".join(words))
        for n in rng.sample(range(1, 7), 3):
            copy = list(words)
            for at in rng.sample(range(300), n):
                copy[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def test_pairs_of_edited_copies_are_found(spark, edited):
    import corpus_pipeline as cp

    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(edited)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert got.columns == list(cp.COLUMNS)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(slow_groups(edited)))


def test_links_of_one_bucket():
    from treefold.llm.jaccard import similar_links

    rng = np.random.default_rng(5)
    sets = [np.zeros(0, np.uint64)] * 2
    for _ in range(30):
        base = rng.integers(0, 400, 40)
        sets += [np.unique(np.append(base[rng.random(40) < 0.93], rng.integers(0, 400, 2))).astype(np.uint64) for _ in range(5)]
    root = list(range(len(sets)))
    for i, j in similar_links(sets[2:]):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    want = list(range(len(sets)))
    for i in range(2, len(sets)):
        for j in range(2, i):
            if similar(set(sets[i].tolist()), set(sets[j].tolist())):
                low, high = sorted((want[i - 2], want[j - 2]))
                want = [low if r == high else r for r in want]
    assert root == want and len(set(want)) < len(sets) - 20


def test_odd_texts_and_empty_table(spark):
    import corpus_pipeline as cp

    texts = [None, "", " \t\n", "one two", "One  TWO", "two one", "a b c d e f", "a b c d e g"]
    rows = [(10 + i, t, None, None, None) for i, t in enumerate(texts)]
    got = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in got) == [10, 13, 15, 16, 17]
    assert cp.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0



def test_rows_without_or_with_one_id_are_not_cut_to_one(spark, edited):
    import corpus_pipeline as cp

    # Different texts without an id, different texts of one id, and a copy of each; the last row is there twice.
    apart = edited[::4]
    rows = [(None, t, "en", "s", 1) for t in apart[:12]] + [(7, t, "en", "s", 1) for t in apart[12:20]] + [(i, t, "en", "s", 1) for i, t in enumerate(apart[20:25], 100)]
    rows += [(None, t + " end", "en", "s", 1) for t in apart[8:25:2]] + [(500 + i, t + " end", "de", "s", 1) for i, t in enumerate(apart[:3])] + [rows[-1]]
    root = slow_groups([t for _, t, *_ in rows])
    groups = collections.defaultdict(list)
    for r, row in zip(root, rows):
        groups[r].append(row)
    runs = [[tuple(r) for r in cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), "").collect()] for n in (1, 5)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    assert len(runs[0]) == len(groups) == 25
    assert collections.Counter(order(i) for i, *_ in runs[0]) == collections.Counter(min(order(i) for i, *_ in g) for g in groups.values())
    assert all(sum(row in g for row in runs[0]) == 1 for g in groups.values())
