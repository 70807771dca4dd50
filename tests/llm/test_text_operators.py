"""Dedup, quality, mixing, packing, media, tokens and chats against brute force, on rows that are odd in every way."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invent(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [invent(rng, rng.randrange(5, 120)) for _ in range(40)]
    passage = invent(rng, 45)
    out = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 3] + "\n" + passage + "\nshared  Line here ok\n\n", "de", None, 1) for i in range(9)]
    out += [(200 + i, f"{passage} x{i}\nSHARED  line HERE ok \nshort\n", "en", "s1", 1) for i in range(6)]
    long = " ".join(f"u{i}" for i in range(6000)) + " " + passage
    out += [(300, long, "fr", "s2", 1), (301, None, None, None, None), (302, "", "en", "", 0), (None, passage, "en", "s0", 1)]
    out += [(303, " \t\n\x0b", "en", "\U0001f600", 1), (304, "é́ \xa0   中文 #*$ <|endoftext|> don't", "zh", "s0", 1), (303, " \t\n\x0b", "en", "\U0001f600", 1)]
    out += [(305, "one two three", "en", "s3", 1), (306, "One two THREE", "en", "s3", 1), (7, base[7], "en", "s3", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return (1 << 63) - 1 if i is None else i


def bag(df, *names):
    return collections.Counter(tuple(r) for r in df.select(*names).collect())


# --- line dedup


def kept_lines(rows, min_key=10):
    holders = collections.defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_key:
                holders[key(line)].add(order(i))
    out = collections.Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_key or min(holders[key(x)]) == order(i)]
        out[i, "\n".join(stay), len(lines), len(lines) - len(stay)] += 1
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines(docs, rows, batches, fanout):
    from treefold.llm.linededup import dedup_lines

    assert bag(dedup_lines(docs, batches, fanout), "doc_id", "text", "n_lines", "n_dropped") == kept_lines(rows)


def test_lines_odd_tables(spark, empty):
    from treefold.llm.linededup import dedup_lines

    assert dedup_lines(empty).count() == 0
    names = "doc_id long, text string, n_lines int, __x string, __doc string, __th int, __lines string, __gone long, row string"
    clash = spark.createDataFrame([(1, "a line that repeats", 7, "h", "d", 1, "l", 2, "r"), (2, "a line that repeats", 8, "i", "e", 3, None, 4, "s")], names)
    got = {r["doc_id"]: r.asDict() for r in dedup_lines(clash, 1).collect()}
    assert got[1]["n_dropped"] == 0 and got[2] == {"doc_id": 2, "text": "", "n_lines": 1, "n_dropped": 1, "__x": "i", "__doc": "e", "__th": 3, "__lines": None, "__gone": 4, "row": "s"}


def test_runs_are_compacted_and_joined_as_they_lie(spark, docs, tmp_path):
    from treefold.llm.linededup import LineRunStore, line_hashes, sorted_scans

    store, lines = LineRunStore(spark, str(tmp_path / "runs"), fanout=2), line_hashes(docs)
    for low in range(0, 40, 8):
        store.add(lines.where(F.col("__doc").between(low, low + 7)))
    assert [len(x) for x in store.levels] == [1, 0, 1] and len(store.live) == 2  # merged runs are gone
    keys = store.keys()
    assert keys.count() == keys.select("__h1", "__h2").distinct().count() > 0
    batch = store.write_run(lines.groupBy("__h1", "__h2").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last")))
    with sorted_scans(spark):
        plan = store.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.close()
    assert not store.live and not [p for p in (tmp_path / "runs").rglob("*.parquet")]


# --- substring dedup


def without_repeats(rows, width):
    seen, out = set(), collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: (order(r[0]), r[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if window in seen:
                gone[s : s + width] = [True] * width
            seen.add(window)
        out[i, " ".join(w for w, g in zip(words, gone) if not g), len(words), sum(gone)] += 1
    return out


@pytest.mark.parametrize("width,chunk", [(20, 8 << 20), (20, 2000), (13, 5000)])
def test_substrings(docs, rows, width, chunk):
    from treefold.llm.substring import remove_repeats

    assert bag(remove_repeats(docs, width, chunk_bytes=chunk), "doc_id", "text", "n_words", "n_removed") == without_repeats(rows, width)


def test_substrings_random_matches(spark):
    """Copies at every alignment of the cover."""
    from treefold.llm.substring import COVER, PERIOD, remove_repeats

    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    rng = random.Random(9)
    core = invent(rng, 21, 10**6)
    rows = [(i, f"{invent(rng, i % 14, 10**6)} {core} {invent(rng, 3, 10**6)}") for i in range(60)]
    got = bag(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=700), "doc_id", "text", "n_words", "n_removed")
    assert got == without_repeats(rows, 20)


def test_substrings_of_rows_without_ids(spark):
    """Rows of one id, or of none, are spread over chunks, and take turns by the hash of their texts."""
    from treefold.llm.substring import remove_repeats

    rng = random.Random(11)
    core = invent(rng, 30, 10**6)
    rows = [(i, f"{invent(rng, 40, 10**6)} {core}") for i in [None] * 30 + [5] * 30]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("c"), "th": F.lit("t")})
    got = remove_repeats(df, chunk_bytes=1000).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [30] * 59
    assert [r["doc_id"] for r in got if not r["n_removed"]] == [5]


def test_messages_stay_below_anchors_at_every_size():
    from treefold.llm.substring import plan_sizes

    for size in (10**9, 3 * 10**10, 10**12, 10**13, 10**14):
        chunks, buckets = plan_sizes(size)
        assert chunks * buckets * 16 <= size / 15


def test_words_that_meet_in_every_polynomial_keep_apart(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2**64 for every odd base."""
    import pyarrow as pa

    from treefold.llm import textnum as tn
    from treefold.llm.substring import remove_repeats

    first = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    second = first.translate(str.maketrans("ab", "ba"))
    data, offsets = tn.raw(pa.array([first, second]))
    starts, ends, _ = tn.words(data, offsets)
    for which in (0, 1):
        assert len(set(tn.hash_spans(data, starts, ends, which).tolist())) == 2
    for n in (16, 32, 64):  # the polynomials' own words
        data, offsets = tn.raw(pa.array([first[:n], second[:n]]))
        starts, ends, _ = tn.words(data, offsets)
        assert len(set(tn.hash_spans(data, starts, ends).tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(19))
    got = remove_repeats(spark.createDataFrame([(1, f"{first} {rest}"), (2, f"{second} {rest}"), (3, f"{first} {rest}")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {1: 0, 2: 0, 3: 20}


def test_substrings_empty(empty):
    from treefold.llm.substring import remove_repeats

    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(empty, 5)


# --- SimHash


def slow_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(list(up), 2):
        if (a ^ b).bit_count() <= radius:
            up[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates(docs, rows):
    from treefold.llm.simhash import fingerprint_hex, near_duplicates

    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    root = slow_components(set(prints), 4)
    least = {}
    for (i, *_), p in zip(rows, prints):
        least[root[p]] = min(least.get(root[p], order(None)), order(i))
    want = collections.Counter((i, f"{p:016x}", least[root[p]] if least[root[p]] != order(None) else i) for (i, *_), p in zip(rows, prints))
    found = near_duplicates(docs).select("doc_id", fingerprint_hex(F.col("fp")).alias("h"), "component_id")
    assert bag(found, "doc_id", "h", "component_id") == want


def test_masks_cover_every_pair():
    from treefold.llm.simhash import covering_masks

    rng = random.Random(2)
    for places in (list(range(64)), sorted(rng.sample(range(64), 31))):
        masks = covering_masks(places, 4)
        assert len(masks) == 31
        for _ in range(3000):
            diff = sum(1 << p for p in rng.sample(places, rng.randrange(1, 5)))
            assert any(m & diff == 0 for m in masks)
    masks = covering_masks(list(range(12)), 2)
    assert all(any(m & (1 << a | 1 << b) == 0 for m in masks) for a, b in itertools.combinations(range(12), 2))


@pytest.mark.parametrize("most", [1 << 14, 6])
def test_links_join_all_near_fingerprints(spark, most):
    """Chains, big clusters and random values; with tiny buckets, through the second dealing."""
    from treefold.llm.simhash import components, links

    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            at ^= sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 6)))
            values.add(at)
    centre = rng.getrandbits(64)
    values |= {centre ^ sum(1 << p for p in rng.sample(range(64), 2)) for _ in range(80)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r["a"]: r["root"] for r in components(links(df, most=most)).collect()}
    groups = lambda m: sorted(sorted(signed(v) for v in g) for g in m)
    mine, want = collections.defaultdict(list), collections.defaultdict(list)
    for v in values:
        mine[got.get(signed(v), signed(v))].append(v)
    for v, r in slow_components(values, 4).items():
        want[r].append(v)
    assert groups(mine.values()) == groups(want.values())


def test_near_duplicates_empty(empty):
    from treefold.llm.simhash import near_duplicates

    assert near_duplicates(empty).count() == 0


# --- tokens, packing


def slow_ids(name, text):
    from tokenizers import Tokenizer

    from treefold.llm.tokenizing import vocabulary

    return Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_encoder_equals_the_library(name):
    from treefold.llm.tokenizing import WordEncoder, vocabulary

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    e, rng = WordEncoder(vocabulary(name), memo_bytes=100_000, stretch=9), random.Random(1)
    bits = [*"abcABC dE  \n\n\t.,!'’st123éÉñßſΣσςİı中́\x1c\x85\xa0 <|>ﬁ१½", "'s", "'ll", " don't", "<|endoftext|>", "<|startoftext|>", "<|endof", "  ", "\r\n", "😀"]
    for i in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        text = " ".join([text, "plain words", text]) if i % 3 == 0 else text
        assert e.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_encoder_memory_is_bounded():
    """Long parts are not remembered; the memo starts anew once its bytes are used up."""
    from treefold.llm.tokenizing import WordEncoder, vocabulary

    e = WordEncoder(vocabulary("byte_bpe_50k.json"), memo_bytes=50_000)
    for i in range(60):
        e.encode("start " + f"{i}abc" * 2000)
    assert max(map(len, [*e.parts, *e.seen])) <= 64 and e.parts.size + e.seen.size < 50_000
    for i in range(3000):
        e.encode(f"word{i} other{i}")
        assert e.parts.size + e.seen.size < 51_000


def test_simple8b_round_trip():
    from treefold.llm.tokenfile import block_edges, pack, unpack

    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1000, 30_000):
        ids = rng.integers(0, 1 << 59, n).astype(np.uint64) >> rng.integers(0, 60, n).astype(np.uint64)
        ids[rng.random(n) < 0.2] = 0
        ids[n // 3 : n // 2] = 0
        edges = block_edges(np.array([n // 2, n - n // 2]), 512)
        words, offsets = pack(ids, edges)
        assert np.array_equal(unpack(words.tobytes()), ids)
        for a, b, c, d in zip(offsets[:-1], offsets[1:], edges[:-1], edges[1:]):
            assert np.array_equal(unpack(words[a:b].tobytes()), ids[c:d])
    with pytest.raises(ValueError):
        pack(np.array([1 << 61], np.uint64), np.array([0, 1]))


def test_token_files(docs, rows, empty):
    from treefold.llm.tokenfile import token_files
    from treefold.llm.tokenizing import vocabulary

    got = sorted(token_files(docs, vocabulary("byte_bpe_50k.json"), segment_ids=300, batch_ids=2000, block_ids=64).collect(), key=lambda r: r["start"])
    assert [order(r["doc_id"]) for r in got] == sorted(order(r[0]) for r in rows)
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    want = collections.Counter((i, len(ids), crc(ids)) for i, t, *_ in rows for ids in [slow_ids("byte_bpe_50k.json", t)])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_differencing_is_near_equal():
    from treefold.llm.packing import differencing, pack_group

    rng = np.random.default_rng(1)
    sizes = rng.integers(50, 900, 400)
    found = differencing(sizes, 50)
    sums = np.bincount(found, sizes, 50)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 60
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]  # the textbook case
    assert np.bincount(pack_group(np.full(10, 2049), 4096), np.full(10, 2049)).max() <= 4096


@pytest.mark.parametrize("group,partitions", [(1024, 1), (16, 3), (4, 5)])
def test_packing(docs, rows, empty, group, partitions):
    from treefold.llm.packing import pack_documents
    from treefold.llm.tokenizing import vocabulary

    path = vocabulary("word_bpe_49k.json")
    got = pack_documents(docs.repartition(partitions), path, group=group).collect()
    windows = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        assert r["length"] in (4096, r["doc_tokens"] % 4096)  # whole windows and one rest: nothing else is cut
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [0, *itertools.accumulate(n for _, n in w)][:-1]
        assert sum(n for _, n in w) <= 4096
    total = sum(r["length"] for r in got)
    assert len(windows) <= -(-total // 4096) + (1 if group == 1024 else len(rows) // group + 1)
    want = collections.defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(np.array(slow_ids("word_bpe_49k.json", t), "<u4").tobytes())
    assert set(want) == set(pieces)
    for i, texts in want.items():
        assert b"".join(x[1] for x in sorted(pieces[i]))[:4] in [t[:4] for t in texts]
        assert sum(len(x[1]) for x in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(x[1] for x in sorted(pieces[i])) == texts[0]
    assert pack_documents(empty, path).count() == 0


def test_pieces_are_cut_only_where_whole_ones_pad_too_much():
    from treefold.llm.packing import pack_pieces

    rng = np.random.default_rng(0)
    whole = [(("d", 0, 0, b""), 0, int(n)) for n in rng.integers(1, 1500, 300)]
    assert sorted(p for w in pack_pieces(whole) for p in w) == sorted(whole)
    half = [((str(i), 0, 0, b""), 0, 2100) for i in range(100)]  # no two fit into a window
    found = pack_pieces(half)
    assert len(found) <= 1.03 * 2100 * 100 / 4096 + 1 and sum(n for w in found for _, _, n in w) == 210_000
    assert all(sum(n for _, _, n in w) <= 4096 for w in found)
    spans = collections.defaultdict(list)
    for w in found:
        for (name, *_), start, n in w:
            spans[name].append((start, start + n))
    assert all(s[0][0] == 0 and s[-1][1] == 2100 and all(a[1] == b[0] for a, b in itertools.pairwise(s)) for s in map(sorted, spans.values()))


# --- media


def test_media(docs, rows, empty):
    from treefold.llm.media import media_columns, payload_digests, texts_as_media

    media = texts_as_media(docs)
    got = {(r["doc_id"], r["payload_sha256"]): r for r in payload_digests(media).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i, hashlib.sha256(full).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(full), zlib.crc32(full[-64:]))
    track = {r["doc_id"]: r for r in media_columns(media).collect()}[300]["tracks"][0]
    data = {r["doc_id"]: r["media"] for r in media.collect()}[300]
    assert track["codec"] == "raw " and track["duration"] == track["n_samples"] and track["key_frames"][1]["time"] == 1.0
    k = track["key_frames"][1]
    assert bytes(data[k["offset"] : k["offset"] + k["length"]]) == rows[[r[0] for r in rows].index(300)][1].encode()[25 * 64 : 26 * 64]
    assert payload_digests(texts_as_media(empty)).count() == 0


def test_probe_other_layouts_and_damage(spark):
    from treefold.llm import media as m

    sizes, chunks = [5, 7, 9, 4], [100, 300]
    stbl = m.box(
        b"stbl",
        m.full_box(b"stsd", (1).to_bytes(4, "big"), m.box(b"avc1", bytes(20))),
        m.full_box(b"stts", *(x.to_bytes(4, "big") for x in (2, 3, 10, 1, 20))),
        m.full_box(b"stss", *(x.to_bytes(4, "big") for x in (2, 1, 4))),
        m.full_box(b"stsc", *(x.to_bytes(4, "big") for x in (2, 1, 3, 1, 2, 1, 1))),
        m.full_box(b"stz2", (8).to_bytes(4, "big"), (4).to_bytes(4, "big"), bytes(sizes)),
        m.full_box(b"stco", *(x.to_bytes(4, "big") for x in (2, *chunks))),
    )
    mdhd = m.full_box(b"mdhd", bytes(16), (90).to_bytes(4, "big"), (900).to_bytes(8, "big"), bytes(4), version=1)
    file = m.box(b"ftyp", b"isom") + m.box(b"free", b"x") + m.box(b"moov", m.box(b"trak", m.box(b"mdia", mdhd, m.box(b"minf", stbl)))) + m.box(b"mdat", bytes(300))
    (t,) = m.probe(file)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 90, 900)
    assert [x.tolist() for x in t.samples()] == [[100, 105, 112, 300], sizes, [0, 10, 20, 30]]
    assert [x.tolist() for x in t.key_frames()] == [[100, 300], [5, 4], [0, 30]]
    bad = [None, b"", b"junk", file[:-3], file[:40], b"\0\0\0\1mdat", m.box(b"mdat", b"x")]
    df = spark.createDataFrame([(i, b, "e") for i, b in enumerate([file, *bad])], "k int, media binary, error string")
    got = m.media_columns(df).orderBy("k").collect()
    assert got[0]["error"] is None and all(r["tracks"] is None and r["error"] for r in got[1:])


# --- quality


def slow_counts(text):
    words = WORD.findall(text or "")
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def labelled(spark, n=200):
    rng = random.Random(8)
    good = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('rstln')}" for _ in range(rng.randrange(60, 120))), 1) for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(["BUY!!", "$$$", "CLICK!!", "###", "NOW!!"]) + str(rng.randrange(50)) for _ in range(70)), 0) for i in range(n // 4)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (10**9, 0), (0, None)], "doc_id long, quality int")
    return docs, labels, {i: y for i, _, y in good + bad}


def test_quality_rules(spark, docs, rows, empty):
    from treefold.llm.quality_rules import COUNTS, judge, quality_rules, train

    got = bag(judge(docs.withColumn("kept", F.lit(3)), None), "doc_id", *COUNTS, "base_failed", "kept")
    want = collections.Counter()
    for i, t, *_ in rows:
        c = slow_counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[i, *c, failed, not failed] += 1
    assert got == want
    known, labels, truth = labelled(spark)
    found = {r["doc_id"]: r["kept"] for r in quality_rules(known, labels).collect()}
    assert all(found[i] == bool(y) for i, y in truth.items())
    assert train(known, labels.where("quality = 1")) is None
    assert quality_rules(empty, labels).count() == 0


def test_quality_classifier(spark, docs, empty):
    from treefold.llm.quality_classifier import classify

    known, labels, truth = labelled(spark)
    found = classify(known, labels, features=64).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in classify(known, flipped, features=64).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in found)
    assert {r["score"] for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(empty, labels).count() == 0


def test_isotonic():
    from treefold.llm.quality_classifier import isotonic

    assert isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 3, 1])).tolist() == [0.1, 0.35, 0.35, 0.9]


# --- mixing


def test_water_fill_and_quotas():
    from treefold.llm.mixing import sainte_lague, water_fill

    t = water_fill(np.array([10.0, 100, 1000]), np.array([5.0, 2, 1]), 3)
    assert t.tolist() == [30, 300, 780]
    rng = np.random.default_rng(2)
    for _ in range(30):
        votes, seats = rng.integers(0, 1000, 7), int(rng.integers(0, 300))
        want = np.zeros(7, int)
        for _ in range(seats if votes.sum() else 0):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert sainte_lague(votes, seats).tolist() == want.tolist()
    assert sainte_lague(np.array([5, 5]), 10, np.array([2, 100])).tolist() == [2, 8]


def test_mixing(spark, docs, rows, empty):
    from treefold.llm.mixing import mix_sources

    got = mix_sources(docs, blocks_per_shard=16).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(s for s in by if s is not None) + [None]
    total = sum(r["size"] for r in got)
    assert abs(sum(b[0]["target"] for b in by.values()) - total) < 1e-6
    for s in names:
        size, target = sum(r["size"] for r in by[s]), by[s][0]["target"]
        assert by[s][0]["source_size"] == size and target <= 3 * size + 1e-6
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(8, 0.01 * target)
    again = mix_sources(docs.repartition(7), blocks_per_shard=16).collect()
    key = lambda r: (order(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix_sources(empty).count() == 0


# --- chats


def slow_chats(rows):
    talks = collections.defaultdict(set)
    for c, turn, role, text in rows:
        talks[c].add((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else 0)
    talks = {c: [x[1:] for x in sorted(t, key=lambda x: (low(x[0]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))] for c, t in talks.items()}
    out = {}
    for c, t in talks.items():
        if any((len(o) > len(t) and o[: len(t)] == t) or (o == t and order(d) < order(c)) for d, o in talks.items() if d != c):
            continue
        out[c] = "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)
    return out


@pytest.mark.parametrize("blocks,part", [(None, 1024), (1, 1024), (37, 3)])
def test_chats(spark, blocks, part):
    from treefold.llm.chat import format_chats

    rng = random.Random(6)
    rows = []
    for c in range(40):
        n = rng.randrange(1, 9)
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", "hello" if i == 0 else f"t{rng.randrange(2)}") for i in range(n)]
    rows += rows[:5] + [(None, None, None, None), (None, 3, "user", ""), (50, 0, None, None), (51, 0, "", ""), (52, -5, "user", "hello"), (52, 7, "assistant", "t0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = collections.defaultdict(list)
    for r in format_chats(df, part, blocks=blocks).collect():
        assert r["n_turns"] <= part
        got[r["conv_id"]].append((r["part"], r["rendered"]))
    assert {c: "".join(x for _, x in sorted(v)) for c, v in got.items()} == slow_chats(rows)
    assert format_chats(df.limit(0)).count() == 0


def test_chats_without_ids_and_of_long_turns(spark):
    """Turns without a conv_id spread over blocks; parts are cut by bytes as well."""
    from treefold.llm.chat import format_chats

    rows = [(None, i % 7, "user", f"text {i:05}") for i in range(3000)] + [(1, 0, "user", "x" * 500), (1, 1, "user", "y" * 500), (1, 2, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("__block", F.lit(1))
    got = collections.defaultdict(list)
    for r in format_chats(df, bytes_per_part=600, blocks=16).collect():
        assert len(r["rendered"]) < 1200 + 40 * r["n_turns"]
        got[r["conv_id"]].append((r["part"], r["rendered"]))
    assert {c: "".join(x for _, x in sorted(v)) for c, v in got.items()} == slow_chats(rows) and len(got[1]) == 2


# --- words and hashes


def test_words_and_windows():
    import pyarrow as pa

    from treefold.llm import textnum as tn

    texts = ["a bb  ccc\n", None, "", "é x\x1cy", " \t", "a bb ccc a bb"]
    data, offsets = tn.raw(pa.array(texts))
    starts, ends, first = tn.words(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = tn.hash_spans(data, starts, ends)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    w = tn.hash_windows(h, 2)
    assert w[0] == w[5] == w[8] and w[0] != w[1] and len(w) == len(h) - 1
    assert list(tn.pieces(6, offsets, 3)) and [b for _, b in tn.pieces(6, offsets, 3)][-1] == 6
