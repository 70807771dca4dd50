"""Shared ground of the training-data operators: scratch tables, ids, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, scratch, shared_dir

__all__ = ["delete", "scratch", "shared_dir"]

#: The six characters that separate words everywhere in this subpackage.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id wherever ids are ordered: null comes last.
LAST_ID = (1 << 63) - 1

def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, cut off from its lineage, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(names: list[str]) -> Column:
    """Columns as one struct ``row``: beside it, computed columns clash with no name of the input."""
    return (F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)).alias("row")


def order_id(doc_id: Column) -> Column:
    """doc_id as a bigint in which null comes after every other id."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(LAST_ID))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def hash128(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of one value, independent of each other for all practical purposes."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


#: Columns of with_row_keys: rows that share all four are one row several times.
ROW_KEYS = ("__id", "__t1", "__t2", "__row")


def with_row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ROW_KEYS: the ordered id, two hashes of the text and one of everything else."""
    t1, t2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns if c not in (id_col, text_col)]
    other = F.xxhash64(*rest, F.col(text_col).isNull(), F.col(id_col).isNull())
    return docs.withColumns({"__id": order_id(F.col(id_col)), "__t1": t1, "__t2": t2, "__row": other})


def least_rows(keyed: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each group of grouped (ROW_KEYS, root) the row of keyed with the least keys: least id (null last), then hashes."""
    leaders = grouped.groupBy("root").agg(F.min(F.struct(*ROW_KEYS)).alias("first")).select("first.*")
    return keyed.join(leaders, list(ROW_KEYS), "left_semi").dropDuplicates(list(ROW_KEYS)).drop(*ROW_KEYS)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
