"""Shared steps of the document operators: stored tables, unique documents, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irisframe.session import scratch_dir

#: Text bytes that one bucket of an exchange stands for.
BYTES_PER_BUCKET = 8 << 20
WHITE = " \t\n\x0b\f\r"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage, so the rows are not computed again by each later use and a
    lost executor costs a reread only. The new plan knows the table's true size.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_key(text: Column | str = "text") -> Column:
    """Tells versions of a document apart that share a doc_id."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def judged_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per document.

    Rows without doc_id take no part. Rows that share a doc_id are one document:
    if their texts differ, the smallest text is the one that is judged.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.filter(F.col("doc_id").isNotNull())
    if slim.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return slim
    return stored(slim.groupBy("doc_id").agg(F.min("text").alias("text")), "versions")


def bucket_count(docs: DataFrame) -> int:
    """Buckets for an exchange of what is derived from all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-total // BYTES_PER_BUCKET))


#: A key is hot if it has more than one in so many rows; so fewer keys are hot.
HOT_SHARE = 500


def joined_on_hot_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for every ``key``
    and its number of ``rows`` as ``count``.

    Rows with a hot key never move: the hot keys, fewer than ``HOT_SHARE`` since
    their shares add up to one, are broadcast. The others meet in a shuffle join.
    Both tables are read twice, so they should be stored.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    table = table.withColumn("_hot", F.col(count) * HOT_SHARE > total)
    hot = F.broadcast(table.filter("_hot").drop("_hot", count))
    rest = table.filter("NOT _hot").drop("_hot", count)
    marks = F.broadcast(table.filter("_hot").select(key))
    return rows.join(hot, key).unionByName(rows.join(marks, key, "left_anti").join(rest, key))
