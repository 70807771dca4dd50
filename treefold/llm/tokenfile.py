"""Token-id files in Simple-8b blocks, packed into the rows of Parquet shards.

A shard holds the documents of one doc_id range in ascending order; its rows are segments of whole documents, cut into
blocks of up to ``block_ids`` ids. A block is a run of 64-bit little-endian words: four bits of selector, 60 bits of
ids. Selector s packs COUNTS[s] ids of WIDTHS[s] bits; the two lowest stand for runs of zeros; the last is the escape
and holds one value of up to 60 bits. A row carries where each of its blocks begins and its first id's place in the
shard, so a reader can decode any block or segment alone, all words of one selector at a time. Parquet is the outer frame so that any store that Spark reaches will do and Spark's commit protocol
covers lost executors and repeated tasks.

Results for odd input: null and empty texts have the end id alone; a null doc_id comes last; rows with equal ids are in
order of their texts' hash, then as separate documents; an empty table makes an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import order_id, scratch
from .textnum import give_back
from .tokenizing import encoder

#: Ids in a word and bits of an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE_BITS = 60
BLOCK_IDS = 1024
END_ID = 2


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes; exact for all of uint64."""
    if int(ids.max()) < 1 << 24:  # a float's exponent tells
        return np.maximum((ids.astype(np.float32).view(np.int32) >> 23) - 126, 0).astype(np.int8)
    size = lambda x: np.frexp(x.astype(np.float64))[1]
    high, low = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, size(high) + 32, size(low)).astype(np.int8)


def block_edges(lengths: np.ndarray, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Places where blocks begin, and the end: each segment is cut into blocks of block_ids from its own start."""
    ends = np.cumsum(lengths)
    cuts = [np.arange(e - n, e, block_ids) for n, e in zip(lengths, ends) if n]
    return np.concatenate([*cuts, [ends[-1] if len(ends) else 0]]).astype(np.int64)


def pack(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of the blocks between edges, all blocks side by side, and where each block's words begin."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(1, np.int64)
    ids = ids.astype(np.uint64)
    need = _bits(ids)
    if int(need.max()) > ESCAPE_BITS:
        raise ValueError(f"an id takes more than {ESCAPE_BITS} bits")
    blocks = len(edges) - 1
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)
    left = np.minimum(left, 255).astype(np.uint8)
    # For each place, the selector that packs most: worst is the widest of the next k ids, k rising by one.
    best, worst, k = np.full(n, len(COUNTS) - 1, np.int8), need.copy(), 1
    for s in range(len(COUNTS) - 2, -1, -1):
        while k < COUNTS[s]:
            np.maximum(worst[: n - k], need[k:], out=worst[: n - k]) if k < n else None
            k += 1
        fits = (worst <= WIDTHS[s]) & (left >= k)
        best[fits] = s
        if COUNTS[s] >= 15 and not fits.any():
            break  # no stretch of k ids is this small, so no longer one is
    # Walk all blocks together: one step packs a word of every block that is not yet done.
    at, end = edges[:-1], edges[1:]
    step, live, starts, of = COUNTS[best], np.arange(blocks), [], []
    while len(live):
        starts.append(at)
        of.append(live)
        at = at + step[at]
        if not (going := at < end).all():
            at, end, live = at[going], end[going], live[going]
    starts, of = np.concatenate(starts), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    starts, of = starts[order], of[order]
    sel = best[starts].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if WIDTHS[s]:
            mine = np.flatnonzero(sel == s)
            for k in range(COUNTS[s]):
                words[mine] |= ids[starts[mine] + k] << np.uint64(k * WIDTHS[s])
    return words.astype("<u8"), np.searchsorted(of, np.arange(blocks + 1))


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one or more whole blocks, decoded selector by selector."""
    words = np.frombuffer(payload, "<u8")
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel]) if len(sel) else np.zeros(0, np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        if WIDTHS[s]:
            mine = np.flatnonzero(sel == s)
            first, mask = ends[mine] - COUNTS[s], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[first + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    return out


FILE_SCHEMA = "shard int, segment int, first_id long, n_ids long, words binary, block_offsets array<int>, doc_ids array<long>, doc_lengths array<long>"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, segment_ids: int = 1 << 16, batch_ids: int = 1 << 20) -> None:
    """Encode every text, append end_id and write the shards; shard order is doc_id order.

    Texts are dealt by range of doc_id (Spark samples the ids to balance the ranges), never gathered.
    """
    order = [order_id(F.col("doc_id")), F.xxhash64("text")]
    ordered = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        parts, names, lengths, segment, done = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, done
            ids, size = np.frombuffer(b"".join(parts), "<u4"), np.array(lengths, np.int64)
            # A segment is the documents that begin within the same stretch of segment_ids ids.
            cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // segment_ids, prepend=-1, append=1 << 60))
            total = np.add.reduceat(size, cut[:-1])
            edges = block_edges(total, block_ids)
            words, offsets = pack(ids, edges)
            first = np.cumsum(total) - total
            block = np.searchsorted(edges, np.append(first, len(ids)))
            raw = words.tobytes()
            cols = [[], [], [], []]
            for a, b, c, d in zip(block[:-1], block[1:], cut[:-1], cut[1:]):
                cols[0].append(raw[8 * offsets[a] : 8 * offsets[b]])
                cols[1].append(offsets[a:b] - offsets[a])
                cols[2].append(names[c:d])
                cols[3].append(lengths[c:d])
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(total), pa.int32()),
                    pa.array(range(segment, segment + len(total)), pa.int32()),
                    pa.array(done + first, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(cols[0], pa.binary()),
                    pa.array(cols[1], pa.list_(pa.int32())),
                    pa.array(cols[2], pa.list_(pa.int64())),
                    pa.array(cols[3], pa.list_(pa.int64())),
                ],
                ["shard", "segment", "first_id", "n_ids", "words", "block_offsets", "doc_ids", "doc_lengths"],
            )
            segment, done = segment + len(total), done + len(ids)
            for x in (parts, names, lengths):
                x.clear()
            return rows

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = enc.encode(text.as_py() or "") + end
                names.append(doc_id)
                lengths.append(len(got) // 4)
                parts.append(got)
                held += len(got) // 4
                if held >= batch_ids:
                    yield flush()
                    held = 0
        if names:
            yield flush()
        give_back()

    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("shard")  # a row a shard
    before = [(int(s), int(c - n)) for s, n, c in zip(totals["shard"], totals["n"], totals["n"].cumsum())]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: [] for c in ("shard", "doc_id", "local", "n_tokens", "ids_crc32")}
            for shard, first, words, ids, lengths in zip(*(batch.column(k).to_pylist() for k in range(5))):
                raw, at = memoryview(unpack(words).astype("<u4").tobytes()), 0
                for name, n in zip(ids, lengths):
                    cols["shard"].append(shard)
                    cols["doc_id"].append(name)
                    cols["local"].append(first + at)
                    cols["n_tokens"].append(n)
                    cols["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_pydict(
                cols, schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
            )

    found = files.select("shard", "first_id", "words", "doc_ids", "doc_lengths").mapInArrow(
        decode, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    offsets = spark.createDataFrame(before, "shard int, __before long")
    return found.join(offsets, "shard").select("doc_id", (F.col("local") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, **names) -> DataFrame:
    """Write docs to a new file set in the shared folder and read it back."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, **names)
    return read_token_files(docs.sparkSession, path)
