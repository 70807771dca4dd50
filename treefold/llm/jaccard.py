"""Near-dedup by the Jaccard similarity of word-shingle sets: MinHash bands find candidates, whole sets decide.

1. One pass makes each text's set of shingle hashes; the set's own hash (sid) and BANDS x ROWS minima leave it.
2. Distinct sets meet in buckets by band. Two sets of similarity s share a bucket with probability
   1 - (1 - s**ROWS)**BANDS: 0.999997 at 0.8, more above. Buckets with the same members count once.
3. Members of shared buckets get their sets back from one text each. Inside a bucket all pairs are compared exactly, save
   those that a chain of links joins already; only a link for each member that is joined leaves it.
4. Components by stars (simhash.components).

Time: a bucket takes time in proportion to its members if they are near copies, and to their square if they share a band
without being similar. Results for odd input: texts without words have the empty set and are equal to each other; a text
of fewer words than a shingle is one shingle as a whole; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ROW_KEYS, least_rows, with_row_keys, written
from .simhash import _TO_LOWER, components
from .textnum import give_back

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 24, 4, 42


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word shingles of one text."""
    import xxhash

    words = (text or "").encode().translate(_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
    hashes = (digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


@functools.cache
def _multipliers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 64, (2, bands * rows, 1), np.uint64)
    return a | np.uint64(1), b


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band: sets with equal minima in all rows of a band have the same key."""
    a, b = _multipliers(bands, rows)
    least = np.full(bands * rows, np.uint64((1 << 64) - 1))
    for low in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, low : low + 2048] * a + b).min(1), out=least)
    key = np.zeros(bands, np.uint64)
    for r in range(rows):
        key = (key ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def prints(keyed: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(__id, __t1, __t2, __row, sid, keys) of rows that have those and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, sid = batch.num_rows, []
            keys = np.zeros((n, bands), np.int64)
            for i, text in enumerate(batch.column(4)):
                s = shingle_set(text.as_py(), shingle)
                sid.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                keys[i] = band_keys(s, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.array(sid, np.uint64).view(np.int64)), lists], [*ROW_KEYS, "sid", "keys"])
        give_back()

    return keyed.select(*ROW_KEYS, "text").mapInArrow(run, "__id long, __t1 long, __t2 long, __row long, sid long, keys array<long>")


def _groups(rows: DataFrame) -> DataFrame:
    """(g, sid): the members of every bucket of two or more, over rows (t, k, sid) sorted by t, k and sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def work(t: np.ndarray, k: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(sid):
                return
            starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, len(sid)))
            g = np.array([xxhash.xxh64_intdigest(sid[s : s + n].tobytes(), SEED) for s, n in zip(starts[sizes > 1], sizes[sizes > 1])], np.uint64)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g.view(np.int64), sizes[sizes > 1])), pa.array(sid[np.repeat(sizes > 1, sizes)])], ["g", "sid"])

        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            # The last bucket may go on in the next batch.
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(new):
                yield from work(*(c[: new[-1]] for c in held))
                held = [c[new[-1] :] for c in held]
        if held:
            yield from work(*held)

    return rows.mapInArrow(run, "g long, sid long")


def similar_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(member, earlier member) links that join exactly what pairs of at least this similarity join.

    Grows one component after the other: each member found is compared with all that are still free, at once.
    """
    n, out = len(sets), []
    sizes = np.array([len(s) for s in sets])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - m : e] for e, m in zip(ends, sizes)]
    mark = np.zeros(len(flat), bool)
    free, joined = np.arange(n), ids
    while len(free) > 1:
        queue, free, joined = [int(free[0])], free[1:], joined[sizes[free[0]] :]
        while queue and len(free):
            x = queue.pop()
            mark[own[x]] = True
            # Prefix sums count the hits of each free set; an empty set has none.
            hits = np.append(0, np.cumsum(mark[joined], dtype=np.int64))
            mark[own[x]] = False
            stops = np.cumsum(sizes[free])
            both = hits[stops] - hits[stops - sizes[free]]
            near = both >= similarity * (sizes[free] + sizes[x] - both) - 1e-9
            if near.any():
                found = free[near].tolist()
                out += [(i, x) for i in found]
                queue += found
                free = free[~near]
                joined = np.concatenate([own[i] for i in free]) if len(free) else joined[:0]
    return out


def _group_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links over rows (g, sid, shingles) sorted by g and sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(sids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
            return [(sids[i], sids[j]) for i, j in similar_links(sets, similarity)]

        now, sids, sets = None, [], []
        for batch in batches:
            out = []
            for g, sid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != now:
                    out += work(sids, sets) if sids else []
                    now, sids, sets = g, [], []
                sids.append(sid)
                sets.append(np.frombuffer(blob.as_py(), np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if sids and (out := work(sids, sets)):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, shingles) of rows (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], ["sid", "shingles"])
        give_back()

    return texts.mapInArrow(run, "sid long, shingles binary")


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each group linked by pairs of at least this similarity, one row.

    It is the row with the least id (null last), and among rows of one id the one with the least hashes.
    """
    keyed = with_row_keys(docs, id_col, text_col)
    known = written(prints(keyed.withColumn("text", F.col(text_col)), shingle, bands, rows), "prints")
    units = written(known.groupBy("sid").agg(F.min(F.struct(*ROW_KEYS)).alias("first"), F.first("keys").alias("keys")), "units")

    banded = units.select("sid", F.posexplode("keys").alias("t", "k")).select("t", "k", "sid")
    members = written(_groups(banded.repartition("t", "k").sortWithinPartitions("t", "k", "sid")).distinct(), "groups")
    wanted = units.join(members.select("sid").distinct(), "sid", "left_semi").select("sid", "first.*")
    texts = keyed.select(*ROW_KEYS, F.col(text_col).alias("text")).join(wanted, list(ROW_KEYS)).dropDuplicates(["sid"]).select("sid", "text")
    sets = written(_sets(texts, shingle), "sets")
    grouped = members.join(sets, "sid").select("g", "sid", "shingles")
    links = written(_group_links(grouped.repartition("g").sortWithinPartitions("g", "sid"), similarity), "similar")

    root = components(links, "similar-stars").withColumnRenamed("a", "sid")
    rooted = units.select("sid", "first.*").join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return least_rows(keyed, rooted)
