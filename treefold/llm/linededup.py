"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table (h1, h2, owner) of distinct 128-bit line hashes, bucketed and sorted by the hash. The documents are read
once to write the hashes of all their lines, split into batches of rising doc_id. Each batch is reduced to its distinct keys
(a sorted run as well), which are merge-anti-joined with every run in the store: what is left is new and becomes a run of its
own; what a run holds has its owner there. Both sides of these joins lie bucketed and sorted alike, so they need neither an
exchange nor a sort. When a level has collected ``fanout`` runs they are merged into one run of the next level and deleted,
so a store of n batches has at most fanout * log(n) runs. Keys with several documents go to one table, and a second reading
of the documents drops their lines; a hot line is one key on either side of the batches' joins, and the last join is one
of plain exchanges, whose hot partitions adaptive execution splits.

Results for odd input: a null or empty text is one empty line; a null doc_id orders after all others and all null ids
count as one document; repeated rows (same id) never drop each other's lines; very long texts are split like others, a row
a line; an empty table gives an empty table; columns of the input that are named like a computed one (n_lines,
n_dropped) are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD_SPACE, ascii_lower, delete, hash128, order_id, packed, scratch, shuffle_width, written

#: Keys shorter than this are never dropped (code points).
MIN_KEY = 10
KEY = ["__h1", "__h2"]
#: Lines for each bucket of a run, until there are as many buckets as shuffle partitions.
BUCKET_LINES = 1 << 17
LINES = "__doc bigint, __th bigint, __pos int, __h1 bigint, __h2 bigint, __batch int"
#: Lets a scan of buckets of one file each tell the planner that they are sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(__doc, __th, __pos, __h1, __h2) of every line whose key has at least min_key code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(order_id(F.col(id_col)).alias("__doc"), F.xxhash64(text).alias("__th"), F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    keys = lines.withColumn("__key", ascii_lower(F.trim(F.col("__line"), F.lit(WORD_SPACE)))).where(F.char_length("__key") >= min_key)
    h1, h2 = hash128(F.col("__key"))
    return keys.select("__doc", "__th", "__pos", h1.alias("__h1"), h2.alias("__h2"))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may rely on the order of bucketed runs."""
    before = spark.conf.get(SORTED_SCAN)
    spark.conf.set(SORTED_SCAN, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCAN, before)


class LineRunStore:
    """The runs of line hashes in one folder. Batches are to come in rising order of doc_id, or own their lines by arrival."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.live: set[str] = set()

    def write_run(self, rows: DataFrame, dealt: bool = False) -> str:
        """Store rows as a table with one sorted file a bucket; rows that are not dealt by bucket yet are dealt first."""
        name = f"treefold_lines_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, *KEY)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        self.live.add(name)
        return name

    def drop_run(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.path}/{name}")
        self.live.discard(name)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def keys(self) -> DataFrame | None:
        """Every key that the store holds, once, with its owner."""
        runs = [self.spark.table(r) for r in self.runs()]
        return reduce(DataFrame.unionAll, runs) if runs else None

    def fresh(self, batch: str) -> DataFrame:
        """The keys of a batch's run that no run of the store has: merge anti-joins, one after the other."""
        return reduce(lambda rows, run: rows.join(self.spark.table(run).select(*KEY).hint("merge"), KEY, "left_anti"), self.runs(), self.spark.table(batch))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of line_hashes; returns (__h1, __h2, __owner) of its keys that a document other than their owner also holds."""
        batch = self.write_run(lines.groupBy(*KEY).agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last")))
        with sorted_scans(self.spark):
            new = self.write_run(self.fresh(batch).select(*KEY, F.col("__first").alias("__owner"), (F.col("__first") < F.col("__last")).alias("__shared")), dealt=True)
            several = [self.spark.table(batch).join(self.spark.table(run).hint("merge"), KEY).where("__owner < __last").select(*KEY, "__owner") for run in self.runs()]
            several.append(self.spark.table(new).where("__shared").select(*KEY, "__owner"))
            shared = written(reduce(DataFrame.unionAll, several), "shared-batch")
            self.drop_run(batch)
            self._keep(0, new)
        return shared

    def _keep(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            # Runs hold different keys, so an outer merge join of sorted runs is their union, sorted.
            both = lambda a, b: a.join(b.hint("merge"), KEY, "full_outer").select(*KEY, F.coalesce(a["__owner"], b["__owner"]).alias("__owner"))
            old = self.levels[level]
            merged = self.write_run(reduce(both, [self.spark.table(r).select(*KEY, "__owner") for r in old]).withColumn("__shared", F.lit(False)), dealt=len(old) == 2)
            self.levels[level] = []
            for r in old:
                self.drop_run(r)
            self._keep(level + 1, merged)

    def close(self) -> None:
        """Delete all runs."""
        for name in list(self.live):
            self.drop_run(name)
        self.levels = []


def drop_lines(docs: DataFrame, lines: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines (line_hashes of docs) whose key a smaller document owns; adds n_lines and n_dropped."""
    hit = lines.join(shared, KEY).where("__doc > __owner")
    gone = hit.groupBy("__doc", "__th").agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(packed([c for c in rest if c != text_col]), text.alias("__text"), order_id(F.col(id_col)).alias("__doc"), F.xxhash64(text).alias("__th"))
    both = keyed.join(gone, ["__doc", "__th"], "left").withColumn("__lines", F.split(F.col("__text"), "\n", -1))
    # What stays are the stretches between dropped lines: one slice each, so the work is linear in the number of lines.
    stretches = F.transform(
        F.arrays_zip(
            F.concat(F.array(F.lit(-1)), F.col("__gone")).alias("a"), F.concat(F.col("__gone"), F.array(F.size("__lines"))).alias("b")
        ),
        lambda z: F.slice(F.col("__lines"), z["a"] + 2, z["b"] - z["a"] - 1),
    )
    kept = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return both.select(
        *[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rest],
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, n_batches: int = 4, fanout: int = 2, min_key: int = MIN_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep each repeated line only in the smallest doc_id that holds it.

    The lines go through a new run store in n_batches doc_id ranges of about equal row count, rising, so that a key's
    owner is known once its batch has been added; one last pass drops the lines.
    """
    spark = docs.sparkSession
    ident = order_id(F.col(id_col))
    cuts = docs.agg(F.percentile_approx(ident, [i / n_batches for i in range(1, n_batches)], 1000)).first()[0] or [] if n_batches > 1 else []
    cuts = sorted(set(cuts))
    batch_of = reduce(lambda n, cut: n + (F.col("__doc") > cut).cast("int"), cuts, F.lit(0))
    path = scratch(spark, "line-hashes")
    line_hashes(docs, id_col, text_col, min_key).withColumn("__batch", batch_of).write.partitionBy("__batch").parquet(path)
    lines = spark.read.schema(LINES).parquet(path)
    n_lines = lines.count()
    store = LineRunStore(spark, scratch(spark, "lines"), fanout, max(1, min(shuffle_width(spark), -(-n_lines // BUCKET_LINES))))
    shared = [store.add(lines.where(F.col("__batch") == b)) for b in range(len(cuts) + 1)]
    store.close()
    # A key may have become shared in several batches; its owner is the same in each.
    # It is written so that both sides of the next join are plain exchanges, which adaptive execution splits at a hot line.
    all_shared = reduce(DataFrame.unionAll, shared).groupBy(*KEY).agg(F.min("__owner").alias("__owner"))
    return drop_lines(docs, lines, written(all_shared, "shared"), id_col, text_col)
