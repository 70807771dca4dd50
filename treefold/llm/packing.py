"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows of ``capacity`` ids and a rest, which stays in one piece. Pieces are packed in
groups of ``group``: each starts as a partial partition of its own, and the two partitions with the widest spread are merged
with opposing imbalances, largest sums on smallest, until one is left, whose windows are near-equal. The window count starts
at the least that could hold the group and rises by one whenever a window exceeds the capacity. Only where that would pad
more than ``waste`` of a group (many pieces just above half a window) are its largest pieces cut in two and packed anew.

Groups form as a partition's rows stream by, without a shuffle. What a partition has left at its end, less than a group, is
stored with the packed windows and packed by the same rule in a second, small pass over all partitions' remainders. A task
holds one group of pieces and one document; a lost task repeats exactly. Sequence ids hold the pass and the partition's
number above SEQUENCE_BITS bits and a counter below.

Results for odd input: null and empty texts have the end id alone; repeated rows and equal ids are separate documents;
null ids stay null; very long texts become many whole windows, written out as they come; an empty table gives an empty
table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written
from .textnum import give_back
from .tokenizing import encoder

CAPACITY = 4096
END_ID = 2
SEQUENCE_BITS = 40


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing; window sums come out near-equal."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right, made = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    # A partition is its sums in falling order, less the least of them, and what each window holds (-1: nothing).
    blank = np.full(windows, -1, np.int64)
    parts = {}
    for i, size in enumerate(sizes.tolist()):
        sums, held = np.zeros(windows, np.int64), blank.copy()
        sums[0], held[0] = size, i
        parts[i] = sums, held
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (a, x), (b, y) = parts.pop(i), parts.pop(j)
        sums, y = a + b[::-1], y[::-1]
        held = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            left[made : made + len(both)], right[made : made + len(both)] = x[both], y[both]
            held[both] = n + made + np.arange(len(both))
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        parts[fresh] = sums, held[order]
        heapq.heappush(heap, (-int(sums[0]), fresh))
        fresh += 1
    (_, held), label = parts[heap[0][1]], np.zeros(n + made, np.int64)
    label[held[held >= 0]] = np.flatnonzero(held >= 0)
    for k in range(made - 1, -1, -1):
        label[left[k]] = label[right[k]] = label[n + k]
    return label[:n]


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY, most: int | None = None) -> np.ndarray | None:
    """The window of each piece; the window count rises while a window exceeds the capacity; None if ``most`` are too few."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while most is None or windows <= most:
        found = differencing(sizes, windows)
        if np.bincount(found, sizes, windows).max(initial=0) <= capacity:
            return found
        windows += 1
    return None


def pack_pieces(pieces: list[tuple], capacity: int = CAPACITY, waste: float = 0.03) -> list[list[tuple]]:
    """Windows of (document, start, length) pieces, each of at most ``capacity`` ids."""
    least = max(1, -(-sum(n for _, _, n in pieces) // capacity))
    longest, found = capacity, None
    while found is None:
        found = pack_group(np.array([n for _, _, n in pieces], np.int64), capacity, least + max(1, int(waste * least)))
        if found is None:  # whole pieces would pad too much
            longest = max(1, longest // 2)
            pieces = [part for piece in pieces for part in cut_evenly(piece, longest)]
    windows: list[list[tuple]] = [[] for _ in range(int(found.max(initial=-1)) + 1)]
    for piece, w in zip(pieces, found.tolist()):
        windows[w].append(piece)
    return [w for w in windows if w]


def cut_evenly(piece: tuple, longest: int) -> list[tuple]:
    """A piece as near-equal pieces, none above ``longest``."""
    doc, start, n = piece
    k = -(-n // longest)
    edges = [start + n * i // k for i in range(k + 1)]
    return [(doc, a, b - a) for a, b in zip(edges[:-1], edges[1:])]


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECES.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_SCHEMA)], schema=PIECE_SCHEMA)


class _Packer:
    """Collects the pieces (document, start, length) of documents (id, ids in all, first id kept, kept ids) and packs full groups."""

    def __init__(self, capacity: int, group: int, first_sequence: int):
        self.capacity, self.group, self.sequence = capacity, group, first_sequence
        self.pending: list[tuple] = []

    def add(self, piece: tuple) -> list[tuple]:
        """The rows that the piece completes."""
        self.pending.append(piece)
        return self.flush() if len(self.pending) >= self.group else []

    def flush(self) -> list[tuple]:
        windows, self.pending = pack_pieces(self.pending, self.capacity) if self.pending else [], []
        return [row for window in windows for row in self.rows(window)]

    def rows(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for (name, total, first, ids), start, n in window:
            yield name, start, n, total, self.sequence, offset, ids[4 * (start - first) : 4 * (start - first + n)]
            offset += n
        self.sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: where it starts there, its sequence and offset, and its ids (uint32, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(vocabulary), _Packer(capacity, group, TaskContext.get().partitionId() << SEQUENCE_BITS)
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                whole = n // capacity * capacity
                for at in range(0, whole, capacity):
                    out += packer.rows([((name, n, 0, ids), at, capacity)])
                    if len(out) >= group:
                        yield _batch(out)
                        out = []
                if n > whole:
                    out += packer.add(((name, n, whole, ids[4 * whole :]), whole, n - whole))
                if len(out) >= group:
                    yield _batch(out)
                    out = []
        out += [(name, start, n, total, None, None, ids) for (name, total, _, ids), start, n in packer.pending]
        if out:
            yield _batch(out)
        give_back()

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(capacity, group, 1 << 62 | TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch in batches:
            for name, start, n, total, _, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if rows := packer.add(((name, total, start, ids), start, n)):
                    yield _batch(rows)
        if rows := packer.flush():
            yield _batch(rows)
        give_back()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(texts.mapInArrow(run, PIECES), "pieces")
    left = first.where("sequence_id is null")
    # Four groups a task: the one window or two that a task's last group pads are few beside the others.
    tasks = max(1, left.count() // (4 * group))
    return first.where("sequence_id is not null").unionAll(left.repartition(tasks).mapInArrow(rest, PIECES))
