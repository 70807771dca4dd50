"""The registered queries against DuckDB, and against plain versions where SQL cannot say it, on a small folder of odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_text_operators import WORD, order, slow_counts, slow_ids

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    passage = text(30)
    rows = [(i, text(rng.randrange(1, 90)) + rng.choice(["", "\n" + passage, "\nA Line that is shared \n\n", " é #* $%"]), "en", rng.choice(["a", "b", "c", None, "é"]), 1) for i in range(150)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "en", "d", 3), (203, "x y z x y z x y z\nx y z\nx y z\n\n\n", "en", "b", 9), (204, text(15_000), "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 150, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    chats = [(c, t, "user" if t % 2 == 0 else "bot", f"t{rng.randrange(2)}" if t else "hi") for c in range(60) for t in range(rng.randrange(1, 7))]
    spark.createDataFrame([*chats, (70, 0, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{base}/conversations.parquet")
    return base, rows


def asked(base, sql):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{base}/{name}.parquet/*.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return collections.Counter(tuple(sorted(zip(names, r), key=lambda x: x[0])) for r in found.fetchall())


def bag(df):
    return collections.Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_line_dedup", "op5_substring_dedup"])
def test_queries_equal_their_sql(spark, folder, name):
    from treefold.llm.queries import ORACLE_SQL, QUERIES

    assert bag(QUERIES[name](spark, folder[0])) == asked(folder[0], ORACLE_SQL[name])


PAYLOAD = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, greatest(1, (n + 63) // 64) * 64 AS m, t FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(encode(t) || repeat('\\x00'::BLOB, CAST(m - n AS BIGINT))) AS payload_sha256 FROM p
"""


def test_payloads_equal_sql(spark, folder):
    from treefold.llm.queries import op4_media_columns

    got = bag(op4_media_columns(spark, folder[0]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256"))
    assert got == asked(folder[0], PAYLOAD)


COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(k - 1) AS n FROM (SELECT doc_id, line, count(*) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM s) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM twice) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
"""


def test_base_counts_equal_sql(spark, folder):
    from treefold.llm.queries import op6_quality_rules

    got = op6_quality_rules(spark, folder[0])
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == asked(folder[0], COUNTS)
    assert got.where("base_failed and kept").count() == 0


def test_mix_equals_a_plain_version(spark, folder):
    """Sizes and targets exactly, taken words near them, and the same again from other partitions."""
    from treefold.llm.queries import op8_mix_sources

    base, rows = folder
    got = op8_mix_sources(spark, base).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    of = {i: s for i, _, _, s, _ in rows}
    assert {r["doc_id"]: (r["size"], r["source"]) for r in got} == {i: (sizes[i], of[i]) for i in sizes}
    per_source = collections.Counter()
    for i, n in sizes.items():
        per_source[of[i]] += n
    names = sorted(s for s in per_source if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    # Pour water until the total is reached: the level at which min(3 * size, level * weight) adds up.
    low, high = 0.0, float(10 * sum(per_source.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * per_source[s], level * weight[s]) for s in names) < sum(sizes.values()) else (low, level)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == per_source[r["source"]] and abs(r["target"] - min(3 * r["source_size"], low * weight[r["source"]])) < 1e-3
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - min(3 * per_source[s], low * weight[s])) <= 1 for s in names)
    assert sum(taken.values()) == sum(sizes.values())


def test_packing_query_equals_the_library(spark, folder):
    from treefold.llm.queries import op3_pack_sequences

    base, rows = folder
    want = {i: slow_ids("word_bpe_49k.json", t) for i, t, *_ in rows}
    seen, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in op3_pack_sequences(spark, base).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for all_of, total in [*((seen[i], len(want[i])) for i in want), *((p, None) for p in places.values())]:
        at = 0
        for a, n in sorted(all_of):
            assert a == at
            at += n
        assert at == total if total is not None else at <= 4096


def test_token_query_equals_the_library(spark, folder):
    from treefold.llm.queries import op10_token_files

    base, rows = folder
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: order(r[0])):
        ids = slow_ids("byte_bpe_50k.json", t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op10_token_files(spark, base).collect()) == want


def test_classifier_equals_a_plain_version(spark, folder):
    """Random cosines, ridge equations of either half, pooled violators: all again, in memory and step by step."""
    from treefold.llm import quality_classifier as qc
    from treefold.llm.queries import op7_quality_classifier

    base, rows = folder
    got = {r["doc_id"]: r for r in op7_quality_classifier(spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet")
    stats = {r["doc_id"]: np.frombuffer(bytes(r["stats"]), "<f4").astype(float) for r in qc.with_statistics(docs).collect()}
    crc = {i: zlib.crc32(str(i).encode()) for i in stats}
    train = [i for i in range(0, 150, 3) if crc[i] % 5]
    x, y = np.stack([stats[i] for i in train]), np.array([i % 2 for i in train], float)
    half = np.array([crc[i] // 5 % 2 for i in train])
    mean, std = x.mean(0), x.std(0)
    rng = np.random.Generator(np.random.PCG64(qc.SEED))
    w, b = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], qc.FEATURES)), rng.uniform(0, 2 * np.pi, qc.FEATURES)

    def lift(v):
        z = np.clip((v - mean) / np.where(std > 1e-9, std, 1), -6, 6)
        return np.append(np.sqrt(2 / qc.FEATURES) * np.cos(z @ w + b), 1.0)

    z, weight = np.stack([lift(v) for v in x]), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = qc.RIDGE * len(y) / z.shape[1] * np.eye(z.shape[1])
    fit = lambda m: np.linalg.solve(z[m].T @ (z[m] * weight[m][:, None]) + ridge, z[m].T @ (weight[m] * y[m]))
    halves = [fit(half == 1), fit(half == 0)]
    bins = np.array([int(np.clip((z[k] @ halves[half[k]] + 0.5) / 2 * qc.BINS, 0, qc.BINS - 1)) for k in range(len(y))])
    at = np.unique(bins)
    level, n = [y[bins == k].mean() for k in at], [(bins == k).sum() for k in at]
    while any(a > c + 1e-15 for a, c in zip(level[:-1], level[1:])):  # pool the first violators until there are none
        k = next(k for k in range(len(level) - 1) if level[k] > level[k + 1] + 1e-15)
        same_left, same_right = [j for j in range(k + 1) if level[j] == level[k]], [j for j in range(k + 1, len(level)) if level[j] == level[k + 1]]
        pool = [j for j in same_left if all(level[i] == level[k] for i in range(j, k + 1))] + [j for j in same_right if all(level[i] == level[k + 1] for i in range(k + 1, j + 1))]
        value = sum(level[j] * n[j] for j in pool) / sum(n[j] for j in pool)
        for j in pool:
            level[j] = value
    theta = fit(np.ones(len(y), bool))
    for i, v in stats.items():
        score = float(np.clip(np.interp(lift(v) @ theta, (at + 0.5) * 2 / qc.BINS - 0.5, level), 0, 1))
        assert abs(got[i]["score"] - score) < 1e-4, (i, got[i], score)
        assert got[i]["held_out"] == (crc[i] % 5 == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_gram_slots_are_those_of_characters():
    import pyarrow as pa

    from treefold.llm import quality_rules as qr
    from treefold.llm import textnum as tn

    texts = ["plain ascii", "é́ 中文字 ١½ 😀😀 end", "", "abc", "中文字符", None, "déjà vu"]
    data, offsets = tn.raw(pa.array(texts))
    starts, ends, first = tn.words(data, offsets)

    def slot(four):
        h = 0
        for c in four:
            h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
        return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - qr.TABLE_BITS)

    want = collections.Counter((k, slot(t[i : i + 4])) for k, t in enumerate(texts) for i in range(len(t or "") - 3))
    for most in (1 << 21, 7, 16):
        got = collections.Counter()
        for kind, slots, docs in qr.grams(data, offsets, tn.hash_spans(data, starts, ends), first, most):
            if kind == 1:
                got.update(zip(docs.tolist(), slots.tolist()))
        assert got == want


def test_copies_of_a_labelled_id_are_one_row(spark):
    """A labelled id with thousands of rows trains once, and the packed sample keeps to its bytes."""
    from treefold.llm.quality_rules import train

    from .test_text_operators import labelled

    docs, labels, _ = labelled(spark)
    copies = docs.where("doc_id = 3").select("doc_id", F.explode(F.array_repeat("text", 5000)).alias("text"))
    one, many = train(docs, labels), train(docs.unionAll(copies), labels)
    assert one.bias == many.bias and np.array_equal(one.tables[0], many.tables[0])
    small = train(docs, labels, max_train_bytes=100_000)
    assert small is not None and not np.array_equal(one.tables[0], small.tables[0])
    assert slow_counts("a b")[0] == 2


def test_big_buckets_stream_over_batches(spark):
    """Buckets that outgrow the limit in the middle of a batch, over several batches and at the end."""
    from treefold.llm.simhash import _bucket_links

    rng = random.Random(4)
    sizes = [1, 30, 2, 3, 25, 9, 1, 40]
    rows = sorted((t, k, rng.getrandbits(62)) for t in range(2) for k, n in enumerate(sizes) for _ in range(n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "t int, k long, fp long").coalesce(1).sortWithinPartitions("t", "k", "fp")
        got = collections.Counter((r["table"], r["a"]) for r in _bucket_links(df, 0, 8).collect() if r["table"] >= 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == collections.Counter((t, fp) for t, k, fp in rows if sizes[k] > 8)
