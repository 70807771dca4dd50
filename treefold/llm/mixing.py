"""Mixing sources to target weights: Sainte-Lague quotas, then a seeded choice of equal-token blocks.

1. One pass counts words and sums them by (source, shard); shards are dealt by a hash of the document, so a hot source has
   many. Only the sums of whole sources go to the driver, one row a source.
2. Targets: each source's share by weight, stopped at ``max_repeat`` times its size, the excess reshared (water filling).
3. Words go to the sources by highest quotients target / (2k + 1), then to a source's shards likewise (on the executors,
   a source at a time, at most ``max_shards`` sums each): whole blocks of ``block`` words and a last partial one, so that a
   source smaller than a block comes to its target as well.
4. Each shard lays its documents out in a seeded order; its quota takes whole rounds of all of them and, for the rest,
   an arc of blocks with a seeded start. A document's take is its size times the rounds plus its overlap with the arc.

Results for odd input: null text has size 0; a very long text is one document that its shard's arc may cut; sources order by code point with null last; a source without words has
target 0; repeated rows are separate documents of equal size; an empty table gives an empty table. Ties in the seeded
order are between rows with the same id and size, which are interchangeable. Columns of the input named like a computed
one (size, source_size, target, taken) are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import order_id, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("bigint")


def water_fill(sizes: np.ndarray, weights: np.ndarray, repeat: float) -> np.ndarray:
    """Shares of sum(sizes) by weight; a share above repeat * size stops there and its excess is reshared."""
    total, target = float(sizes.sum()), np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        left = total - float((repeat * sizes[~free]).sum())
        share = left * weights / weights[free].sum()
        over = free & (share > repeat * sizes)
        if not over.any():
            target[free] = share[free]
            break
        free &= ~over
    target[~free] = repeat * sizes[~free]
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1); ties to the earlier; no one gets more than ``most``.

    Starts from a lower bound of every quota, so the heap deals out only about one seat for each competitor.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    if votes.sum() <= 0 or seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = 0.0, seats / votes.sum() * 2 + 1 / votes[votes > 0].min()
    for _ in range(200):  # the largest divisor whose rounded quotas still fit
        mid = (low + high) / 2
        if np.minimum(np.floor(votes * mid + 0.5 - 1e-9), most).sum() <= seats:
            low = mid
        else:
            high = mid
    given = np.minimum(np.floor(votes * low + 0.5 - 1e-9), most).astype(np.int64)
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, given)) if v > 0 and k < most[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - given.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    max_block: int = 1024,
    blocks_per_shard: int = 2048,
    max_shards: int = 4096,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document (id, its text's hash): size, source_size, target of its source, words taken, and how they are taken.

    __passes whole copies, and of one more copy the words [__from1, __to1) and [__from2, __to2).
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(max_shards)).cast("int").alias("__fine"),
    )
    sized = written(sized, "sizes")
    sums = sized.groupBy("source", "__fine").agg(F.sum("size").alias("n"))
    totals = [(r["source"], int(r["n"])) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()]  # a row a source
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [s for s, _ in totals], np.array([n for _, n in totals], np.int64)
    total = int(sizes.sum())
    block = max(1, min(max_block, total // 65536))
    per = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    target = water_fill(sizes, per, max_repeat) if total else np.zeros(len(names))
    given = sainte_lague(target, total, max_repeat * sizes)
    shards = np.clip(sizes // (block * blocks_per_shard), 1, max_shards)
    sources = spark.createDataFrame(
        list(zip(names, shards.tolist(), given.tolist(), sizes.tolist(), target.tolist())),
        "__src string, __shards long, __given long, source_size long, target double",
    )
    held = sums.join(sources, sums["source"].eqNullSafe(sources["__src"])).groupBy("__src", "__shards", "__given", "source_size", "target", F.floor(F.col("__fine") * F.col("__shards") / max_shards).alias("__shard"))

    def quotas(rows: pa.Table) -> pa.Table:
        """Sainte-Lague once more, over the shards of one source."""
        rows = rows.sort_by("__shard")
        size = rows.column("__held").to_numpy()
        quota = sainte_lague(size, rows.column("__given")[0].as_py(), max_repeat * size)
        words = np.maximum(size, 1)
        out = rows.select(["__src", "__shards", "__shard", "__held", "source_size", "target"])
        return out.append_column("__passes", pa.array(np.where(size, quota // words, 0))).append_column("__rest", pa.array(np.where(size, quota % words, 0)))

    plan = held.agg(F.sum("n").alias("__held")).groupBy("__src").applyInArrow(
        quotas, "__src string, __shards long, __shard long, __held long, source_size long, target double, __passes long, __rest long"
    )
    # The plan has a row a shard; the join below is by source and by every fine shard that the shard covers.
    fine = plan.withColumn(
        "__fine",
        F.explode(F.sequence(F.ceil(F.col("__shard") * max_shards / F.col("__shards")).cast("int"), F.ceil((F.col("__shard") + 1) * max_shards / F.col("__shards")).cast("int") - 1)),
    )
    joined = sized.join(fine, sized["source"].eqNullSafe(fine["__src"]) & (sized["__fine"] == fine["__fine"]))
    order = Window.partitionBy("__src", "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "__th"), order_id(F.col("doc_id")), "size")
    laid = joined.withColumn("__end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("__begin", F.col("__end") - F.col("size"))
    blocks = F.greatest(F.ceil(F.col("__held") / F.lit(block)), F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "__src", "__shard"), blocks) * block
    laid = laid.withColumn("__arc", start).withColumn("__stop", F.col("__arc") + F.col("__rest"))

    def overlap(low: Column, high: Column) -> tuple[Column, Column]:
        a = F.least(F.greatest(low - F.col("__begin"), F.lit(0)), F.col("size"))
        b = F.least(F.greatest(high - F.col("__begin"), F.lit(0)), F.col("size"))
        return a.cast("bigint"), F.greatest(a, b).cast("bigint")

    (a1, b1), (a2, b2) = overlap(F.col("__arc"), F.col("__stop")), overlap(F.lit(0), F.col("__stop") - F.col("__held"))
    laid = laid.withColumns({"__from1": a1, "__to1": b1, "__from2": a2, "__to2": b2})
    return laid.select(
        "doc_id", "source", "__th", "size", "source_size", "target",
        (F.col("__passes") * F.col("size") + F.col("__to1") - F.col("__from1") + F.col("__to2") - F.col("__from2")).alias("taken"),
        "__passes", "__from1", "__to1", "__from2", "__to2",
    )
