"""SimHash near-dedup: fingerprints of word shingles, linked through covering bit masks, components by stars.

Covering: give each of the 64 bit places a nonzero code of radius + 1 bits. For every nonzero vector v of that many bits
the mask M(v) has the places whose code is odd against v. Two fingerprints that differ in at most ``radius`` places have
some v even against all their codes, so their bits under M(v) agree: every pair within the radius meets in one of the
2**(radius + 1) - 1 tables, without fail. A bucket is a range of a sorted partition; inside it numpy compares members
and only a star for each of its components leaves it, never all pairs. A bucket above ``most`` members is dealt out anew
by covering masks on the bits that its table left free: after that step a bucket has 16 free bits, so 65,536 at most.
A task streams such a bucket on as its rows arrive and never holds more than ``most`` of them.

Results for odd input: null and empty texts have fingerprint zero and link like any other; a null doc_id comes last and
is reported as null only for itself; repeated rows share their component; very long texts are hashed in stretches of
shingles; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import order_id, written
from .textnum import give_back

SHINGLE, SEED, RADIUS = 4, 42, 4
UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one whole text: a bit is set if more than half of the shingle hashes have it."""
    import xxhash

    words = (text or "").encode().translate(_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest, stops = xxhash.xxh64_intdigest, ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for low in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[low : low + (1 << 16)], stops[low : low + (1 << 16)])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row and its bigint columns ``keep``; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *keep])
        give_back()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return texts.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in keep)]))


def covering_masks(places: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit places such that any two values differing in at most radius of them agree under one."""
    codes = 1 << (radius + 1)
    code = {p: 1 + i % (codes - 1) for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() & 1) for v in range(1, codes)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, centre) links that join exactly what pairs within the radius join among the members of one bucket."""
    n = len(members)
    label, links = np.arange(n), []
    step = max(1, (1 << 22) // n)
    for low in range(0, n, step):
        near = np.bitwise_count(members[low : low + step, None] ^ members[None, :]) <= radius
        for i in range(len(near)):
            mine = np.flatnonzero(near[i])
            roots = np.unique(label[mine])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    moved = np.flatnonzero(label != np.arange(n))
    return [(members[moved], members[label[moved]])] if len(moved) else links


def _bucket_links(sorted_rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Over rows (bucket columns..., fp) sorted by bucket: links, and the members of buckets above ``most`` as (fp, null)."""
    keys = [c for c in sorted_rows.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("table", pa.int32())])

        def work(cols: list[np.ndarray], fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(fp):
                return
            new = np.ones(len(fp), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.append(np.flatnonzero(new), len(fp))
            sizes, a, b, t = np.diff(starts), [], [], []
            # Most shared buckets are pairs, which are compared all at once.
            pair = starts[:-1][sizes == 2]
            near = np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius
            a.append(fp[pair + 1][near])
            b.append(fp[pair][near])
            t.append(np.full(int(near.sum()), -1))
            for s, e in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2]):
                if most is not None and e - s > most:
                    a.append(fp[s:e])
                    b.append(fp[s:e])
                    t.append(np.full(e - s, cols[0][s]))
                    continue
                for x, y in _stars(fp[s:e], radius):
                    a.append(x)
                    b.append(y)
                    t.append(np.full(len(x), -1))
            a, b, t = (np.concatenate(x) for x in (a, b, t))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(t.astype(np.int32))], schema=schema)

        def outsize(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp = pa.array(cols[-1])
            return pa.RecordBatch.from_arrays([fp, fp, pa.array(cols[0].astype(np.int32))], schema=schema)

        held: list[np.ndarray] = []
        big = None  # the bucket that has outgrown ``most`` and goes on in the next batch
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if big is not None:
                other = np.flatnonzero(np.logical_or.reduce([c != b for c, b in zip(cols[:-1], big)]))
                n = int(other[0]) if len(other) else batch.num_rows
                if n:
                    yield outsize([c[:n] for c in cols])
                if n == batch.num_rows:
                    continue
                cols, big = [c[n:] for c in cols], None
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            # The last bucket may go on in the next batch.
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:-1]])) + 1
            if len(new):
                cut = int(new[-1])
                yield from work([c[:cut] for c in held[:-1]], np.ascontiguousarray(held[-1][:cut]).view(np.uint64))
                held = [c[cut:] for c in held]
            if most is not None and held and len(held[0]) > most:
                yield outsize(held)
                big, held = [c[0] for c in held[:-1]], []
        if held:
            yield from work(held[:-1], np.ascontiguousarray(held[-1]).view(np.uint64))

    return sorted_rows.mapInArrow(run, "a long, b long, table int")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = 1 << 14) -> DataFrame:
    """(a, b) links over distinct fingerprints (column fp) that connect exactly those that pairs within the radius connect."""
    masks = covering_masks(list(range(64)), radius)

    def dealt(rows: DataFrame, keys: list) -> DataFrame:
        return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp")

    tables = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    found = written(_bucket_links(dealt(rows, ["t", "k"]), radius, most), "links")
    linked = found.where("table < 0").select("a", "b")
    over = found.where("table >= 0").select(F.col("table").alias("t"), F.col("a").alias("fp"))
    if over.isEmpty():
        return linked
    # The big buckets once more: same table and key, and a mask over the places that the table left free.
    again = None
    for i, m in enumerate(masks):
        free = [p for p in range(64) if not m >> p & 1]
        subs = covering_masks(free, radius)
        part = over.where(F.col("t") == i).select(
            F.lit(i).cast("int").alias("t"),
            F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"),
            F.explode(F.array(*[F.struct(F.lit(j).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("k")) for j, s in enumerate(subs)])).alias("y"),
            "fp",
        )
        part = part.select("t", "k", F.col("y.t").alias("t2"), F.col("y.k").alias("k2"), "fp")
        again = part if again is None else again.unionAll(part)
    more = _bucket_links(dealt(again, ["t", "k", "t2", "k2"]), radius, None).select("a", "b")
    return linked.unionAll(written(more, "links2"))


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """(a, root) for every a of the edges (a, b): root is the least value of its component.

    Alternating large and small stars, on written tables: each round is two grouped minima and joins, whose groups are
    never gathered; the number of rounds grows with the logarithm of the longest chain.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()
    now, seen = written(now, tag), None

    def digest(edges: DataFrame) -> tuple:
        """Equal for equal sets of edges."""
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    while True:
        # Large star: every larger neighbour points at the least of the closed neighbourhood.
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point at the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), tag)
        if (state := digest(after)) == seen:
            return after.select("a", F.col("b").alias("root"))
        now, seen = after, state


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, most: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach."""
    prints = written(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    least = written(prints.groupBy("fp").agg(F.min(order_id(F.col("doc_id"))).alias("first")), "distinct")
    root = components(links(least.select("fp"), radius, most))
    rooted = least.join(root.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(of_root, "root").select("fp", "component_id")
    own = F.when(F.col("component_id") == order_id(F.lit(None)), F.col("doc_id")).otherwise(F.col("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", own.alias("component_id"))


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
