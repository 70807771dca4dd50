"""Substring dedup with difference-cover anchors.

A repeat is a window of WIDTH words that also starts earlier in the corpus. Anchors are windows of ``width - period + 1``
words at places whose number modulo ``period`` is in a difference cover: whatever two places a long match has, some
shift below the period brings both onto cover places, so the two copies share an aligned anchor. Hence:

1. every chunk of documents sends the distinct hashes of its anchors to hash buckets; a bucket answers each chunk with
   one bit a hash: whether another chunk has it too;
2. a window is a candidate if it begins within a period before a shared anchor; chunks extend those to the whole window,
   send its 96-bit hash with the first document that has it, and buckets answer whether an earlier document has it;
3. each chunk marks its windows that are not the first of their kind and drops the words that they cover.

Chunks are rows by a hash of doc_id and text, so rows that share an id, or have none, are spread as well; a passage that
many documents share reaches a bucket once a chunk, not once a document. A chunk and a bucket exchange one message each
way; both grow with the root of the input up to MOST_SCALE times their least size (plan_sizes), so that a message holds
many anchors at every size up to 100 TB and the number of messages stays below the number of anchors. All three
passes read one exchange of the texts in one plan: nothing is collected and any lost part can be computed again.

Results for odd input: null and empty texts have no words; a null doc_id comes last; rows with equal ids are taken in
the order of a hash of their texts, the later as the later document; words are kept as they are; very long texts are a
chunk of their own size; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .base import LAST_ID, shuffle_width

WIDTH = 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 is one of two members of the cover
LEAST_CHUNK, LEAST_BUCKET = 8 << 20, 4 << 20  # bytes of text, anchors
ROOT_FROM, MOST_SCALE = 64 << 30, 8  # bytes of input from which chunks and buckets grow, and how far
BLOB = "chunk int, bucket int, step int, payload binary"
BLOB_SCHEMA = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("step", pa.int32()), ("payload", pa.binary())])


class _Chunk:
    """The documents of one chunk in order, and what both passes need of them."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows.column("doc_id").combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        hashes = rows.column("th").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((hashes, ids))
        self.rows = rows.set_column(rows.column_names.index("text"), "text", rows.column("text").cast(pa.large_string())).take(pa.array(order))
        self.ids, self.texts_hash, self.width = ids[order], hashes[order], width
        self.texts = self.rows.column("text").combine_chunks()
        self.data, self.offsets = tn.raw(self.texts)
        self.starts, self.ends, self.first = tn.words(self.data, self.offsets)
        self.n = len(self.starts)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.first))
        self.full = tn.inside(self.first, self.n, width)  # places where a whole window starts
        self.hashes = tn.hash_spans(self.data, self.starts, self.ends)

    def anchors(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of all anchors, the number of each one's distinct hash, and the distinct hashes' buckets and values."""
        span = self.width - PERIOD + 1
        in_text = np.arange(self.n) - np.repeat(self.first[:-1], np.diff(self.first))
        long = np.repeat(np.diff(self.first) >= self.width, np.diff(self.first))
        at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[in_text % PERIOD] & long & tn.inside(self.first, self.n, span))
        h = tn.hash_windows(self.hashes, span)[at] if len(at) else np.zeros(0, np.uint64)
        # A bucket and 32 bits are enough here: a chance meeting only makes a candidate that step 2 turns down.
        key = ((h >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        distinct, which, count = np.unique(key, return_inverse=True, return_counts=True)
        return at, which, distinct, count

    def candidates(self, replies: dict[int, bytes], n_buckets: int) -> np.ndarray:
        """Places of the windows that may be repeats."""
        at, which, distinct, count = self.anchors(n_buckets)
        shared = count > 1
        bucket = (distinct >> np.uint64(32)).astype(np.int64)
        shared |= _answers(replies, bucket)
        hits = np.zeros(self.n + 1, np.int64)
        hits[at + 1] = shared[which]
        hits = np.cumsum(hits)
        here = np.flatnonzero(self.full)
        return here[hits[here + PERIOD] > hits[here]]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows at some places."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        second = tn.hash_spans(self.data, self.starts, self.ends, 1)
        return tn.hash_windows(self.hashes, self.width)[at], (tn.hash_windows(second, self.width, 1)[at] >> np.uint64(32)).astype(np.uint32)


def _answers(replies: dict[int, bytes], bucket: np.ndarray) -> np.ndarray:
    """The answered bits for entries that are sorted by bucket."""
    out = np.zeros(len(bucket), bool)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        if (bits := replies.get(int(bucket[a]))) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def _blobs(chunk: int, step: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """One row for each bucket: its entries column by column, each column byte plane by byte plane."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(edges[1:], len(bucket))
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    payload = [b"".join(planes(np.ascontiguousarray(c[a:b])) for c in columns) for a, b in zip(edges, ends)]
    return pa.table([pa.array([chunk] * len(edges), pa.int32()), pa.array(bucket[edges].astype(np.int32)), pa.array([step] * len(edges), pa.int32()), pa.array(payload, pa.binary())], schema=BLOB_SCHEMA)


def _unblob(payload: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n, at, out = len(payload) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        planes = np.frombuffer(payload, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def _reply(rows: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table([rows.column("chunk"), rows.column("bucket"), rows.column("step"), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], schema=BLOB_SCHEMA)


def _told(replies: pa.Table, step: int) -> dict[int, bytes]:
    return {b: p for b, s, p in zip(*(replies.column(c).to_pylist() for c in ("bucket", "step", "payload"))) if s == step}


def _by_window(chunk: _Chunk, at: np.ndarray, n_buckets: int):
    """Candidate windows by (bucket, hash, place): their order, the sorted hashes, and which of them are the first of their kind here."""
    h1, h2 = chunk.windows(at)
    bucket = (h1 % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((h2, h1, bucket))
    h1, h2, bucket = h1[order], h2[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order, h1, h2, bucket, new


def plan_sizes(n_bytes: int, least_chunk: int = LEAST_CHUNK, least_bucket: int = LEAST_BUCKET, parallel: int = 1) -> tuple[int, int]:
    """How many chunks and buckets an input of so many bytes takes."""
    scale = min(MOST_SCALE, max(1.0, (n_bytes / ROOT_FROM) ** 0.5))
    n_chunks = max(1, -(-n_bytes // int(least_chunk * scale)))
    # About five bytes a word, and one word in three has an anchor.
    return n_chunks, int(max(min(n_chunks, parallel), -(-n_bytes // int(15 * least_bucket * scale))))


def remove_repeats(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = LEAST_CHUNK, bucket_anchors: int = LEAST_BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): every text's kept words joined by one space."""
    if width < PERIOD:
        raise ValueError(f"windows of fewer than {PERIOD} words have no anchor")
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n_chunks, n_buckets = plan_sizes(n_bytes, chunk_bytes, bucket_anchors, shuffle_width(spark))
    ident, th = F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.pmod(F.xxhash64(ident, th), F.lit(n_chunks)).cast("int").alias("chunk"), ident.alias("doc_id"), th.alias("th"), F.col(text_col).alias("text"))

    def send_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, distinct, _ = _Chunk(rows, width).anchors(n_buckets)
        return _blobs(key[0].as_py(), 1, (distinct >> np.uint64(32)).astype(np.int64), [distinct.astype(np.uint32)])

    def shared_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        values = [_unblob(p, [np.dtype("<u4")])[0] for p in rows.column("payload").to_pylist()]
        every = np.sort(np.concatenate(values))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        found = (np.searchsorted(twice, v) for v in values)
        return _reply(rows, [np.append(twice, 0)[f] == v if len(twice) else np.zeros(len(v), bool) for f, v in zip(found, values)] if len(twice) else [np.zeros(len(v), bool) for v in values])

    def send_windows(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return BLOB_SCHEMA.empty_table()
        chunk = _Chunk(rows, width)
        at = chunk.candidates(_told(replies, 1), n_buckets)
        order, h1, h2, bucket, new = _by_window(chunk, at, n_buckets)
        owner = chunk.doc[at[order]][new]
        return _blobs(key[0].as_py(), 2, bucket[new], [h1[new], h2[new], chunk.ids[owner], chunk.texts_hash[owner]])

    def earlier_windows(key: tuple, rows: pa.Table) -> pa.Table:
        kinds = [np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8"), np.dtype("<i8")]
        parts = [_unblob(p, kinds) for p in rows.column("payload").to_pylist()]
        h1, h2, doc, th = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((th, doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        late = np.empty(len(order), bool)
        late[order] = ~new
        return _reply(rows, np.split(late, np.cumsum([len(p[0]) for p in parts])[:-1]))

    out_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def drop(key: tuple, rows: pa.Table, replies: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return out_schema.empty_table()
        chunk = _Chunk(rows, width)
        at = chunk.candidates(_told(replies, 1), n_buckets)
        order, _, _, bucket, new = _by_window(chunk, at, n_buckets)
        late = ~new
        late[new] = _answers(_told(replies, 2), bucket[new])
        step = np.zeros(chunk.n + 1, np.int64)
        places = at[order][late]
        np.add.at(step, places, 1)
        np.add.at(step, np.minimum(places + width, chunk.n), -1)
        covered = np.cumsum(step)[: chunk.n] > 0
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = gone[chunk.first[1:]] - gone[chunk.first[:-1]]
        data, kept = chunk.data.tobytes(), []
        for i, n in enumerate(removed):
            words = data[chunk.offsets[i] : chunk.offsets[i + 1]].split()
            kept.append(b" ".join(compress(words, (~covered[chunk.first[i] : chunk.first[i + 1]]).tolist()) if n else words))
        return pa.table(
            [chunk.rows.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(chunk.first), pa.int64()), pa.array(removed, pa.int64())],
            schema=out_schema,
        )

    by_chunk = lambda df: df.groupBy("chunk")
    first = by_chunk(texts).applyInArrow(send_anchors, BLOB).groupBy("bucket").applyInArrow(shared_anchors, BLOB)
    second = by_chunk(texts).cogroup(by_chunk(first)).applyInArrow(send_windows, BLOB).groupBy("bucket").applyInArrow(earlier_windows, BLOB)
    return by_chunk(texts).cogroup(by_chunk(first.unionAll(second))).applyInArrow(drop, "doc_id long, text string, n_words long, n_removed long")
