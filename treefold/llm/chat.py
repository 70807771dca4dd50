"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation anew after every turn, so a table holds a conversation and its own prefixes. Each
turn prefix gets a rolling hash: the sum of position-keyed hashes of the turns so far, four times 30 bits, which takes
one running sum and no concatenation. A conversation is a snapshot if its whole hash is a strict prefix of another
one's, found by an anti-join on (length, hash); among equal conversations the smallest conv_id stays. What remains are
the maximal conversations, which are rendered in parts of at most ``turns_per_part`` turns and about ``bytes_per_part``
bytes, so that no task has to hold an unbounded conversation.

All turns are dealt by range of (conversation, turn, role, text) into ``blocks`` parts, so a huge conversation, or all turns
without a conv_id, lie in many of them. Running sums are taken inside (conversation, block) and block offsets, at most
``blocks`` a conversation, are joined on. A block's sums have room for 2**33 turns.

Order inside a conversation: turn, then role, then text; nulls first. Rows that are equal in all four columns count
once. A null conv_id is a conversation of its own that comes last; null roles and texts hash apart from empty ones and
render as empty; a turn longer than a part is a part of its own; part numbers rise from 0 and may skip one where both
limits fall together; an empty table gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import order_id, shuffle_width, written

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
HASHES = ["__p1", "__p2", "__p3", "__p4"]
HASH_BITS = 30


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]


def prefix_hashes(turns: DataFrame, blocks: int | None = None) -> DataFrame:
    """(conv, turn, role, text, pos, before, p1..p4): place of every distinct turn row, bytes of text before it, and the rolling hash up to it."""
    rows = turns.select(order_id(F.col("conv_id")).alias("__conv"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    dealt = rows.repartitionByRange(blocks or shuffle_width(turns.sparkSession), F.col("__conv"), *_order())
    rows = written(dealt.withColumn("__block", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("__conv", "__block").orderBy(*_order())
    key = ["__conv", "__block"]

    size = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.sum(size.cast("bigint")).alias("__bytes"))
    offsets = sizes.select(*key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__bytes")])
    placed = rows.withColumn("__in", F.row_number().over(in_block)).withColumn("__upto", F.sum(size.cast("bigint")).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(offsets, key).withColumn("__pos", (F.col("__in") + F.col("__n_before")).cast("bigint"))
    placed = placed.withColumn("__before", F.col("__upto") - size + F.col("__bytes_before"))

    modulus = F.lit(1 << HASH_BITS)
    shape = [F.col("__pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    placed = placed.withColumns({f"{name}h": F.pmod(F.xxhash64(F.lit(i), *shape), modulus) for i, name in enumerate(HASHES)})
    placed = placed.withColumns({name: F.sum(f"{name}h").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) for name in HASHES})
    totals = placed.groupBy(*key).agg(*[F.pmod(F.sum(f"{name}h"), modulus).alias(f"{name}t") for name in HASHES])
    totals = totals.select(*key, *[F.coalesce(F.sum(f"{name}t").over(earlier), F.lit(0)).alias(f"{name}b") for name in HASHES])
    placed = placed.join(totals, key)
    return placed.select("__conv", "turn", "role", "text", "__pos", "__before", *[F.pmod(F.col(n) + F.col(f"{n}b"), modulus).alias(n) for n in HASHES])


def collapse_snapshots(turns: DataFrame, blocks: int | None = None) -> DataFrame:
    """The turn rows (conv, turn, role, text, pos, before) of maximal conversations, each once."""
    hashed = written(prefix_hashes(turns, blocks), "prefixes")
    length = hashed.groupBy("__conv").agg(F.max("__pos").alias("__len"))
    placed = hashed.select("__conv", "__pos", *HASHES).join(length, "__conv")
    whole = placed.where("__pos = __len").groupBy("__pos", *HASHES).agg(F.min("__conv").alias("__conv"))  # copies: the smallest id stays
    inner = placed.where("__pos < __len").select("__pos", *HASHES).distinct()
    maximal = whole.join(inner, ["__pos", *HASHES], "left_anti").select("__conv")
    return hashed.join(maximal, "__conv", "left_semi").select("__conv", "turn", "role", "text", "__pos", "__before")


def format_chats(turns: DataFrame, turns_per_part: int = 1024, bytes_per_part: int = 64 << 20, blocks: int | None = None) -> DataFrame:
    """(conv_id, part, n_turns, rendered): maximal conversations in chat markup, in parts of bounded size."""
    kept = collapse_snapshots(turns, blocks)
    line = F.concat(F.lit(HEAD), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(TAIL))
    part = F.floor((F.col("__pos") - 1) / turns_per_part) + F.floor(F.col("__before") / bytes_per_part)
    parts = (
        kept.select("__conv", "__pos", part.cast("bigint").alias("part"), line.alias("__line"))
        .groupBy("__conv", "part")
        .agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("__pos", "__line"))).alias("__lines"))
    )
    return parts.select(
        F.when(F.col("__conv") != order_id(F.lit(None)), F.col("__conv")).alias("conv_id"), "part", "n_turns",
        F.array_join(F.transform("__lines", lambda x: x["__line"]), "").alias("rendered"),
    )
