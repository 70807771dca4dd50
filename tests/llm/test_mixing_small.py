"""Sources smaller than a block come to their targets."""

import collections

import numpy as np


def test_small_sources_beside_a_large_one(spark):
    from treefold.llm.mixing import mix_sources

    # 4.2 million words make blocks of 64 words; the small sources hold 1 to 60 words, and one 1,000.
    rows = [(i, " ".join(["word"] * 2000), "a") for i in range(2100)]
    rows += [(10000 + i, " ".join(["few"] * (1 + i)), f"s{i:02}") for i in range(60)] + [(20000, "w " * 1000, "t")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=20).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target), [(s, taken[s], target[s]) for s in target if abs(taken[s] - target[s]) > 1][:5]
    assert sum(taken.values()) == sum(size.values())


def test_quotas_of_words_at_large_totals():
    from treefold.llm.mixing import sainte_lague, water_fill

    sizes = np.array([10**12, 5 * 10**11, 300, 1000, 7, 0])
    target = water_fill(sizes, np.array([5.0, 2.0, 1.0] * 2), 3)
    given = sainte_lague(target, int(sizes.sum()), 3 * sizes)
    assert given.sum() == sizes.sum() and (given <= 3 * sizes).all() and (abs(given - target) <= 1).all()
    held = np.full(4096, 10**8)
    assert sainte_lague(held, 3 * 10**11 + 5, 3 * held).sum() == 3 * 10**11 + 5
