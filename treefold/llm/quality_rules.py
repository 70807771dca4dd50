"""Quality rules: plain text counts, and a calibrated logistic regression over hashed word and character n-grams.

The model is a mean of gram weights: word unigrams and bigrams and character 4-grams (of code points) fall into two hashed
tables, a text's score is the bias and the mean weight of either kind of gram. It is fitted on at most ``max_train`` labelled
ids (the lowest by a hash of doc_id; one row an id, the one whose text has the least hash) and at most ``max_train_bytes`` of their packed
grams (in that order; documented bounds, the only ones) by one task, calibrated by a Platt sigmoid on a fifth of
them that the fit does not see, and shipped to the executors as two fixed-size arrays. Scoring runs in Arrow batches over whole texts.

Results for odd input: null and empty texts have zero counts and fail the base rules; null ids or labels are not trained
on; without labels of both kinds the verdict is to keep; repeated rows get equal results; very long texts are taken in
stretches of characters; an empty table gives an empty table; columns of the input that clash with a computed name are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

TABLE_BITS = 16
MAX_TRAIN, MAX_TRAIN_BYTES = 3000, 256 << 20
#: A text is kept if its calibrated probability of label 1 is at least this.
KEEP_AT = 0.5
MIN_WORDS = 50
#: In hundredths of the words.
MAX_REPEATED = 50
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NOT_FIRST_BYTE = (np.arange(256) & 0xC0) == 0x80
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of marks between consecutive edges, which run from 0 to the end."""
    out = np.zeros(len(edges) - 1, np.int64)
    some = edges[1:] > edges[:-1]
    if some.any():
        out[some] = np.add.reduceat(marks, edges[:-1][some], dtype=np.int64)
    return out


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Marks of words in windows of ``width`` words that the same text has twice or more."""
    n = len(hashes)
    at = np.flatnonzero(tn.inside(first, n, width))
    covered = np.zeros(n, bool)
    if len(at):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        key = tn.mix(tn.hash_windows(hashes, width)[at] + tn.mix(doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(width):
            covered[at[twice] + k] = True
    return covered


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen and line.split():
            n += 1
        seen.add(line)
    return n


def counts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The five base counts of every text."""
    raw = data.tobytes()
    return [
        np.diff(first),
        per_text(~tn.IS_SPACE[data] & ~NOT_FIRST_BYTE[data], offsets),
        per_text(SYMBOLS[data], offsets),
        np.array([dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64),
        per_text(repeated_words(hashes, first), first),
    ]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each begins; one that is cut off at the end is not whole."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), np.arange(len(data))
    at = np.flatnonzero(~NOT_FIRST_BYTE[data])
    out = data[at].astype(np.uint32)
    wide = np.flatnonzero(out >= 0xC0)  # few in most texts
    first = out[wide]
    more = [data[np.minimum(at[wide] + k, len(data) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
    two, three = (first & 0x1F) << 6 | more[0], (first & 0x0F) << 12 | more[0] << 6 | more[1]
    four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    out[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return out, at


def grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, slots, texts) of all word grams (kind 0) and, stretch by stretch, of all 4-grams of characters (kind 1)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - TABLE_BITS)
    two = np.flatnonzero(tn.inside(first, len(hashes), 2))
    pairs = tn.hash_windows(hashes, 2)[two] if len(two) else np.zeros(0, np.uint64)
    yield 0, np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64), np.concatenate([doc, doc[two]])
    for low in range(0, len(data), most):
        # Grams begin inside the stretch; the 16 bytes behind it hold their other three characters.
        chars, at = code_points(data[low : low + most + 16])
        n = min(int(np.searchsorted(at, most)), len(chars) - 3)
        if n <= 0:
            continue
        step = np.uint32(0x01000193)
        four = (((chars[:n] * step + chars[1 : n + 1]) * step + chars[2 : n + 2]) * step + chars[3 : n + 3]) * np.uint32(0x9E3779B1)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at[: n + 3], offsets - low)))
        whole = of[:n] == of[3:]
        yield 1, (four >> np.uint32(32 - TABLE_BITS))[whole].astype(np.int64), of[:n][whole]


def parts(texts: pa.Array) -> Iterator[tuple]:
    """(texts, data, offsets, hashes, first) for stretches of a column of texts of bounded size."""
    _, at = tn.raw(texts)
    for low, high in tn.pieces(len(texts), at):
        part = texts.slice(low, high - low)
        data, offsets = tn.raw(part)
        starts, ends, first = tn.words(data, offsets)
        yield part, data, offsets, tn.hash_spans(data, starts, ends), first


@dataclass
class GramModel:
    """A bias, two weight tables, and the sigmoid's slope and shift."""

    bias: float
    tables: tuple[np.ndarray, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def score(self, found: Iterator[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total, count = np.zeros((2, n)), np.zeros((2, n))
        for kind, slot, doc in found:
            total[kind] += np.bincount(doc, self.tables[kind][slot], n)
            count[kind] += np.bincount(doc, minlength=n)
        return self.bias + (total / np.maximum(count, 1)).sum(0)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over scores, by Newton steps on smoothed targets."""
    pos, neg = label.sum(), len(label) - label.sum()
    want = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - want) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_grams(rows: list[tuple[bytes, bytes, bytes, bytes, int]], epochs: int = 15, batch: int = 256, rate: float = 0.3, decay: float = 1e-6) -> GramModel | None:
    """Adam in small batches on the class-weighted log loss over sparse rows (slots and shares of either kind, label).

    Memory beyond the packed rows is that of one batch. None without both labels.
    """
    label = np.array([r[4] for r in rows], float)
    if not len(label) or label.min() == label.max():
        return None
    held = np.arange(len(rows)) % 5 == 4
    if min(label[held].sum(), (1 - label[held]).sum(), label[~held].sum(), (1 - label[~held]).sum()) < 1:
        held = np.zeros(len(rows), bool)
    size = 1 << TABLE_BITS
    w, m, v = (np.zeros(2 * size + 1) for _ in range(3))
    fit = np.flatnonzero(~held)
    weight = np.where(label == 1, 0.5 / label[fit].mean(), 0.5 / max(1 - label[fit].mean(), 1e-9))

    def unpacked(at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for k in (0, 2):
            slot = [np.frombuffer(rows[i][k], "<u4") for i in at]
            doc = np.repeat(np.arange(len(at)), [len(s) for s in slot])
            out.append((np.concatenate(slot).astype(np.int64) + k // 2 * size, doc, np.concatenate([np.frombuffer(rows[i][k + 1], "<f4") for i in at])))
        return out

    def scores(kinds: list, n: int) -> np.ndarray:
        return w[-1] + sum(np.bincount(doc, w[slot] * share, n) for slot, doc, share in kinds)

    rng, t = np.random.Generator(np.random.PCG64(5)), 0
    for _ in range(max(epochs, -(-60 * batch // len(fit)))):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            kinds, t = unpacked(part), t + 1
            miss = (_sigmoid(scores(kinds, len(part))) - label[part]) * weight[part] / len(part)
            grad = decay * w
            for slot, doc, share in kinds:
                grad += np.bincount(slot, miss[doc] * share, len(w))
            grad[-1] += miss.sum()
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    on = np.flatnonzero(held) if held.any() else fit
    s = np.concatenate([scores(unpacked(part), len(part)) for part in np.array_split(on, -(-len(on) // batch))])
    slope, shift = platt(s, label[on])
    return GramModel(float(w[-1]), (w[:size].astype(np.float32), w[size:-1].astype(np.float32)), slope, shift)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", max_train_bytes: int = MAX_TRAIN_BYTES) -> GramModel | None:
    """Fit on at most max_train labelled ids of docs (labels: doc_id, quality), and at most so many bytes of packed grams."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_train)  # at most max_train small rows: a bounded broadcast
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = texts.groupBy("__id").agg(F.min_by("__text", F.xxhash64(F.coalesce("__text", F.lit("")))).alias("__text"), F.first("__y").alias("__y"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part, data, offsets, hashes, first in parts(batch.column(1)):
                cols = [[], [], [], []]
                found = list(grams(data, offsets, hashes, first))
                for k in range(2):
                    slots = [doc << TABLE_BITS | slot for kind, slot, doc in found if kind == k]
                    key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *slots]), return_counts=True)
                    cut = np.searchsorted(key >> TABLE_BITS, np.arange(len(part) + 1))
                    for a, b in zip(cut[:-1], cut[1:]):
                        cols[2 * k].append((key[a:b] & ((1 << TABLE_BITS) - 1)).astype("<u4").tobytes())
                        cols[2 * k + 1].append((count[a:b] / max(1, count[a:b].sum())).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *(pa.array(c, pa.binary()) for c in cols), batch.column(2).slice(at, len(part))], ["id", "a", "b", "c", "d", "y"]
                )
                at += len(part)
        tn.give_back()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                held += sum(len(x) for x in r[1:5])
                if held <= max_train_bytes or not rows:
                    rows.append(r)
            if held > max_train_bytes:
                break
        rng = np.random.Generator(np.random.PCG64(3))
        model = fit_grams([rows[i][1:] for i in rng.permutation(len(rows))])
        if model is not None:
            cells = [[model.bias], [model.slope], [model.shift], [model.tables[0].tobytes()], [model.tables[1].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["bias", "slope", "shift", "a", "b"])

    # The sample is bounded, so one task can hold it; the driver gets the two tables alone.
    found = sample.mapInArrow(sparse, "id long, a binary, b binary, c binary, d binary, y int").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")
    for r in found.mapInArrow(fit, "bias double, slope double, shift double, a binary, b binary").collect():
        return GramModel(r["bias"], tuple(np.frombuffer(bytes(r[c]), np.float32) for c in "ab"), r["slope"], r["shift"])
    return None


def judge(docs: DataFrame, model: GramModel | None, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, probability and kept."""
    new = (*COUNTS, "base_failed", "probability", "kept")
    rest = [c for c in docs.columns if c not in new]
    at = rest.index(text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema]
    schema = ", ".join([*fields, *(f"{c} long" for c in COUNTS), "base_failed boolean, probability double, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part, data, offsets, hashes, first in parts(batch.column(at)):
                base = counts(data, offsets, first, hashes)
                failed = (base[0] < MIN_WORDS) | (100 * base[4] > MAX_REPEATED * base[0])
                p = np.ones(len(part)) if model is None else model.probability(model.score(grams(data, offsets, hashes, first), len(part)))
                rows = batch.slice(low, len(part))
                low += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *(pa.array(b.astype(np.int64)) for b in base), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))], [*rest, *new]
                )
        tn.give_back()

    return docs.select(*rest).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on labels, then judge every document."""
    return judge(docs, train(docs, labels, max_train, id_col, text_col), keep_at, text_col)
