"""Applying verdicts on rows to the tables that they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Largest broadcast, in bytes, that an operator makes on its own account.
BROADCAST_BYTES = 32 << 20


def fitting(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, already cut, to be broadcast if its counted rows fit in ``BROADCAST_BYTES``; else joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """``docs`` without the rows that ``verdict`` (``__i, __h, kept``: id, hash of the text, decision) drops.

    Rows are told apart by id and hash of the text, so repeated rows leave one row if one of them is kept.
    """
    i, h, own = fresh(docs, "__i", "__h", "__hash")
    renamed = verdict.select(F.col("__i").alias(i), F.col("__h").alias(h), "kept")
    keys = cut(renamed.groupBy(i, h).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    gone, twice = cut(keys.filter("not kept").select(i, h)), cut(keys.filter("kept and n > 1").select(i, h))
    tagged = docs.withColumn(own, text_hash)
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h))
    left = tagged.join(fitting(gone, 64), same, "left_anti")
    if twice.isEmpty():
        return left.drop(own)
    once = fitting(twice, 64)
    single = left.join(once, same, "left_semi").dropDuplicates([id_col, own])
    return left.join(once, same, "left_anti").unionByName(single).drop(own)
