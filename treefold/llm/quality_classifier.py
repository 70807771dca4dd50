"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed once, in Arrow batches, and kept as a small table. A Gaussian kernel over
the standardised statistics is approximated by ``features`` random cosines; every partition of the labelled training
rows sums its share of the normal equations, and the sums are added up in a tree of constant memory, so the fit covers
all training rows and its cost at the driver depends on ``features`` alone. Raw scores are calibrated by isotonic
regression (pool adjacent violators) over a fixed grid of score bins, and by cross-fitting: the rows of either half are
scored with the weights of the other half's equations, so no row is calibrated by a fit that saw it.

Only the text is an input. Rows whose crc32(doc_id as text) is 0 modulo 5 are held out from everything that is learnt.

Results for odd input: null and empty texts have all-zero statistics and are scored like any other; a null id counts as
empty text for the hold-out rule; null labels and labels of unknown documents are left out; without training labels of
both kinds every score is the share of label 1, or 0.5 without any; repeated rows get equal scores; very long texts are
taken whole, one at a time; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .base import shuffle_width, written
from .quality_rules import NOT_FIRST_BYTE, dup_lines, parts, per_text, repeated_words

FEATURES = 256
RIDGE = 1e-3
SEED = 11
BINS = 2048
PREDICT_AT = 0.3
#: Byte classes whose shares are statistics.
_CLASSES = [np.isin(np.arange(256), list(c)) for c in (bytes(range(65, 91)), bytes(range(48, 58)), b".", b",;:", b"!?", b"#*$%&", b"|<>", b"\n", b"(){}[]", b"/\\@_=+~^`", b"\"'-")]
_CLASSES += [np.arange(256) >= 0x80, tn.IS_SPACE]
N_STATS = len(_CLASSES) + 13


def statistics(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """N_STATS numbers of every text."""
    n = len(offsets) - 1
    size, words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    some, some_words = np.maximum(size, 1), np.maximum(words, 1)
    out = [per_text(c[data], offsets) / some for c in _CLASSES]
    doc = np.repeat(np.arange(n), np.diff(first))
    starts, ends, _ = tn.words(data, offsets)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / some_words
    square = np.bincount(doc, length**2, n) / some_words
    capital = _CLASSES[0][data[starts]] if len(starts) else np.zeros(0, bool)
    second = np.minimum(starts + 1, ends - 1) if len(starts) else starts
    shout = capital & _CLASSES[0][data[second]] & (ends - starts > 1) if len(starts) else capital
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    key = np.sort(tn.mix(hashes + tn.mix(doc.astype(np.uint64))) & ~np.uint64(0xFFFFFF) | (doc & 0xFFFFFF).astype(np.uint64))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] & np.uint64(0xFFFFFF)).astype(np.int64), minlength=n)[:n]
    raw = data.tobytes()
    lines = per_text(data == 10, offsets) + 1.0
    dup = np.array([dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], float)
    wide = length > 14
    out += [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)),
        np.bincount(doc, capital, n) / some_words, np.bincount(doc, shout, n) / some_words, np.bincount(doc, follows, n) / some_words,
        distinct / np.sqrt(some_words), distinct / some_words, per_text(repeated_words(hashes, first), first) / some_words,
        dup / lines, np.log1p(words / lines), np.bincount(doc, wide, n) / some_words,
    ]
    return np.stack(out, 1) * (size > 0)[:, None]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row; stats holds N_STATS doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(data, offsets, hashes, first).astype("<f4") for _, data, offsets, hashes, first in parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for s in stats for r in s], pa.binary())], ["doc_id", "stats"])
        tn.give_back()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats binary")


def matrix(stats: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(stats.to_pylist()), "<f4").reshape(-1, N_STATS).astype(float)


def summed(rows: DataFrame, share: Callable[[pa.RecordBatch], np.ndarray], fan_in: int = 32) -> np.ndarray | None:
    """The sum of share(batch) over all batches: each partition adds up its own, and at most fan_in streaming adders the rest."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = share(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                got = np.frombuffer(x.as_py(), "<f8")
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    # However many partitions rows has, so many adders stream their sums and one row of each goes to the driver.
    sums = rows.mapInArrow(local, "sum binary").repartition(min(fan_in, shuffle_width(rows.sparkSession))).mapInArrow(add, "sum binary")
    found = [np.frombuffer(bytes(r[0]), "<f8") for r in sums.collect()]  # at most fan_in rows of fixed size
    return sum(found[1:], found[0]) if found else None


class Kernel:
    """Standardisation, random cosines, weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.theta = np.zeros(features + 1)
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
        return self.lift(x) @ (self.theta if theta is None else theta)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit_kernel(known: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Kernel | float:
    """Fit on rows (stats, y, half: 0 or 1); a constant score where there are not both labels."""
    moments = summed(known, lambda b: np.concatenate([[b.num_rows, b.column(1).to_numpy(zero_copy_only=False).sum()], (x := matrix(b.column(0))).sum(0), (x**2).sum(0)]))
    if moments is None or moments[1] in (0, moments[0]):
        return 0.5 if moments is None else float(moments[1] / moments[0])
    n, positive = moments[:2]
    mean = moments[2 : 2 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[2 + N_STATS :] / n - mean**2, 0))
    kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    size = features + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, half = kernel.lift(matrix(batch.column(0))), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        w = np.where(y == 1, n / (2 * positive), n / (2 * (n - positive)))  # both labels weigh the same
        return np.concatenate([part for h in (0, 1) for zh, wh in [(z[half == h], w[half == h])] for part in ((zh.T @ (zh * wh[:, None])).reshape(-1), zh.T @ (wh * y[half == h]))])

    sums = summed(known, equations).reshape(2, -1)
    solved = lambda s: np.linalg.solve(s[: size * size].reshape(size, size) + ridge * n / size * np.eye(size), s[size * size :])
    kernel.theta = solved(sums.sum(0))
    other = [solved(sums[1]), solved(sums[0])]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = matrix(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, kernel.raw(x, other[0]), kernel.raw(x, other[1]))
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    bins = known.mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("bin")
    weight = bins["n"].to_numpy(float)
    level = isotonic(bins["y"].to_numpy(float) / weight, weight)
    kernel.curve = ((bins["bin"].to_numpy(float) + 0.5) * 2 / BINS - 0.5, level)
    return kernel


def classify(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document (labels: doc_id, quality)."""
    check = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    held = (check % 5 == 0).alias("held_out")
    stats = written(with_statistics(docs, id_col, text_col).select("*", held), "stats")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    train = stats.where("not held_out").join(known, "doc_id").select("stats", "y", (F.floor(check / 5) % 2).cast("int").alias("half"))
    kernel = fit_kernel(train, features, ridge, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2))
            score = np.full(len(x), kernel) if isinstance(kernel, float) else kernel.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "stats").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
