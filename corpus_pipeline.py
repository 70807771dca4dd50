"""A training corpus in five stages: quality rules, line dedup, near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treefold.llm.base import ROW_KEYS, least_rows, order_id, scratch, with_row_keys, written
from treefold.llm.jaccard import drop_similar
from treefold.llm.linededup import dedup_lines
from treefold.llm.mixing import mix_sources
from treefold.llm.packing import pack_documents
from treefold.llm.quality_rules import quality_rules
from treefold.llm.simhash import components, fingerprints, links
from treefold.llm.tokenizing import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents, with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    Null and empty texts fail the base rules and go; rows that repeat get equal verdicts; null ids are judged like others;
    very long texts are judged whole; other columns of the input are left out; an empty table stays empty.
    """
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated line stays in the smallest document that has it; documents of which nothing is left go.

    Null ids come last and count as one document, so they keep each other's lines, as do rows of one id; a null text
    becomes an empty one; other columns of the input are left out; an empty table stays empty.
    """
    kept = dedup_lines(docs.select(*COLUMNS))
    return _with_text(kept.where("n_dropped < n_lines or n_dropped = 0"), F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id; of equal or null ids, with the least hashes."""
    keyed = with_row_keys(docs.select(*COLUMNS))
    prints = written(fingerprints(keyed, keep=ROW_KEYS), "prints")
    root = components(links(prints.select("fp").distinct())).withColumnRenamed("a", "fp")
    return least_rows(keyed, prints.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What SimHash links goes first; then of pairs of similarity 0.8 or more over five-word shingles, which it mostly misses.

    Rows are told apart by id and text, never by id alone: different texts that share an id or have none all stay, true
    copies are one group whatever their ids. Texts without words are one group; an empty table stays empty.
    """
    return drop_similar(written(drop_near_duplicates(spark, docs, sf_dir), "simhash-kept"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __n, which tells rows of one id, text and source apart."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__th", "__src").orderBy(*order)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and of one more copy the words that its blocks hold.

    Rows that repeat are separate documents, each with its own share of the plan; null sources are a source of their own;
    texts without words are taken no time; an empty table stays empty.
    """
    source = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("__src")
    plan = mix_sources(docs).select(order_id(F.col("doc_id")).alias("__id"), "__th", source, "size", "__passes", "__from1", "__to1", "__from2", "__to2")
    keyed = docs.select(*COLUMNS, order_id(F.col("doc_id")).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"), source)
    plan = _numbered(plan, ["__passes", "__from1", "__to1", "__from2", "__to2"])
    taken = _numbered(keyed, ["lang", "n_chars"]).join(plan, ["__id", "__th", "__src", "__n"])
    spans = F.concat(
        F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("b")), F.col("__passes").cast("int")),
        F.array(F.struct(F.col("__from1").alias("a"), F.col("__to1").alias("b")), F.struct(F.col("__from2").alias("a"), F.col("__to2").alias("b"))),
    )
    copies = taken.select(*COLUMNS, "size", F.explode(F.filter(spans, lambda s: s["b"] > s["a"])).alias("__span"))
    words = F.split(F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    whole = (F.col("__span.a") == 0) & (F.col("__span.b") == F.col("size"))
    some = F.array_join(F.slice(words, (F.col("__span.a") + 1).cast("int"), (F.col("__span.b") - F.col("__span.a")).cast("int")), " ")
    return _with_text(copies, F.when(whole, F.col("text")).otherwise(some))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document.

    Every row is a document of its own, whatever its id; null and empty texts have the end id alone; an empty table has
    no pieces.
    """
    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", near_dedup),
    ("mix sources", mix),
    ("pack", pack),
]
#: A trained verdict and token ids are beyond SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, so that a stage's rows are computed once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
