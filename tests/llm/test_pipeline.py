"""Each stage of the corpus pipeline against a plain version of its own, on its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from .test_text_operators import WORD, kept_lines, order, slow_components, slow_counts, slow_fingerprint, slow_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('rstln')}{rng.choice('aeiou')}"
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(word() for _ in range(rng.randrange(12, 40))) for _ in range(6))
        rows.append((i, text + ("\nall rights reserved by us" if i % 3 == 0 else ""), "en", f"s{i % 3}", len(text)))
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]
    rows += [(200 + i, rows[10 + i][1].replace(" ", "  ", 3).replace("\n", " ") + " tail", "en", None, 1) for i in range(5)]
    rows += [(300 + i, " ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "###"]) + str(rng.randrange(60)) for _ in range(90)), "en", "s1", 1) for i in range(12)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, "too short", "en", "s2", 9), (None, rows[20][1] + " more", "en", "s1", 3)]
    base = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i, *_ in rows if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near dedup", "mix sources", "pack"]
    before = rows_of(docs)

    good = cp.keep_quality(spark, docs, corpus).persist()
    after = rows_of(good)
    assert set(after) <= set(before)
    gone = {i for i, *_ in before} - {i for i, *_ in after}
    assert {i for i, t, *_ in before if slow_counts(t)[0] < 50} <= gone and {300 + i for i in range(12)} <= gone
    assert gone <= {i for i, *_ in before if i is not None and 300 <= i}

    lines = cp.drop_repeated_lines(spark, good, corpus).persist()
    want = collections.Counter((i, t) for (i, t, n, gone), k in kept_lines(after).items() if gone < n or gone == 0 for _ in range(k))
    assert collections.Counter((i, t) for i, t, *_ in rows_of(lines)) == want
    assert all(n == len(t) for _, t, _, _, n in rows_of(lines)) and lines.columns == list(cp.COLUMNS)

    near = cp.drop_near_duplicates(spark, lines, corpus).persist()
    inp, out = rows_of(lines), rows_of(near)
    prints = {order(i): slow_fingerprint(t) for i, t, *_ in inp}
    root = slow_components(set(prints.values()), 4)
    groups = collections.defaultdict(list)
    for i, p in prints.items():
        groups[root[p]].append(i)
    assert sorted(order(i) for i, *_ in out) == sorted(map(min, groups.values()))
    assert set(out) <= set(inp)

    mixed = cp.mix(spark, near, corpus).persist()
    taken = collections.Counter()
    texts = {i: WORD.findall(t) for i, t, *_ in out}
    for i, t, *_ in rows_of(mixed):
        words = WORD.findall(t)
        taken[i] += len(words)
        assert " ".join(words) in " ".join(texts[i])
    total = sum(map(len, texts.values()))
    assert all(n <= 3 * len(texts[i]) for i, n in taken.items()) and abs(sum(taken.values()) - total) < 0.05 * total

    packed = cp.pack(spark, mixed, corpus).collect()
    tokens = sum(len(slow_ids("word_bpe_49k.json", t)) for _, t, *_ in rows_of(mixed))
    assert sum(r["length"] for r in packed) == tokens


def test_run_and_empty_tables(spark, corpus, tmp_path):
    assert cp.run(spark, corpus).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).where(F.col("length") > 0).count() == 0


def test_stages_on_repeated_and_missing_ids(spark, tmp_path):
    """Rows that share an id, a text, both or neither: no different text is lost, and each row has its own share of the mix."""
    rng = random.Random(31)
    text = lambda n=70: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n))
    apart = [(i, text(), "en", s, 1) for i, s in [(None, "a"), (None, "a"), (None, None), (5, "a"), (5, "b"), (6, "a")]]
    same = text()
    rows = apart + [(7, same, "en", "a", 1)] * 3 + [(7, same, "en", "b", 1), (8, same, "de", None, 2), (9, None, None, None, None), (9, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"__id": F.lit(1), "kept": F.lit("x"), "row": F.lit(2)})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = cp.keep_quality(spark, docs, str(tmp_path))
    assert collections.Counter(rows_of(good)) == collections.Counter(rows[:-2])
    assert {t for _, t, *_ in rows_of(cp.drop_repeated_lines(spark, docs, ""))} >= {t for _, t, *_ in apart}
    near = rows_of(cp.near_dedup(spark, docs, ""))
    assert sorted(t for _, t, *_ in near if t) == sorted([*(t for _, t, *_ in apart), same]) and len(near) == 8
    words = lambda rows: collections.Counter((i, s, t.split()[0] if t else "") for i, t, _, s, _ in rows)
    mixed = rows_of(cp.mix(spark, docs, ""))
    taken = sum(len(WORD.findall(t)) for _, t, *_ in mixed)
    assert abs(taken - sum(len(WORD.findall(t or "")) for _, t, *_ in rows)) <= 3 and len(words(mixed)) > 0
    packed = cp.pack(spark, docs, "").collect()
    assert sum(r["length"] for r in packed) == sum(len(slow_ids("word_bpe_49k.json", t)) for _, t, *_ in rows)
