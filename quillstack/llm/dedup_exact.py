"""Exact deduplication with a heavy-hitter split (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .rows import fitting, keep_rows


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id, __digest``: lowercase hex SHA-256 of each text after lower-casing A-Z; null counts as empty."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("__id"), F.sha2(text, 256).alias("__digest"))


def frequent(rows: DataFrame, tracked: int) -> list[str]:
    """At most ``tracked`` digests, among them each that has over 1/tracked of the rows (Misra-Gries counters).

    Counters are kept for slices of the rows first and then merged, so that no task merges those of all tasks.
    """
    slices = rows.select("__digest", F.pmod(F.spark_partition_id(), F.lit(64)).alias("__slice"))
    parts = slices.groupBy("__slice").agg(F.expr(f"approx_top_k_accumulate(__digest, {4 * tracked})").alias("__s"))
    # By a key, as a combination of no counters at all, which a task without rows would make, isn't defined.
    top = parts.groupBy((F.col("__slice") >= 0).alias("__all")).agg(F.expr(f"approx_top_k_combine(__s, {4 * tracked})").alias("__s")).select(F.expr(f"approx_top_k_estimate(__s, {tracked})").alias("top"))
    row = top.first()
    return [x["item"] for x in (row["top"] if row else None) or [] if x["item"] is not None]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the largest id stays.
    Misra-Gries counters find at most ``tracked`` digests that could hold over 1/tracked of the rows; an exact count
    verifies them and picks their winners, which are broadcast (at most ``tracked`` rows) so that their copies are
    settled on the map side. All other digests are counted, partially before the shuffle, and the groups of several
    rows are joined back, by broadcast if they are few, else by an ordinary shuffle; no group is gathered in one task.

    Defined cases: null text counts as empty; null ids rank below all others; of repeated rows (same id and text)
    one is kept; an empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    slim = cut(digests(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()))
    best = F.max(F.struct(F.coalesce(F.col("__id"), F.lit(-(2**63))), "__row", F.col("__id").alias("id")))
    some = frequent(slim, tracked)
    heavy = slim.filter(F.col("__digest").isin(some)).groupBy("__digest").agg(F.count("*").alias("__n"), best.alias("__best"))
    total = slim.count()
    winners = [(r["__digest"], r["__n"], r["__best"]["id"], r["__best"]["__row"]) for r in heavy.filter(F.col("__n") * tracked > total).collect()] if some else []
    heads = docs.sparkSession.createDataFrame(winners, "__digest string, __n long, __keep long, __kept_row long")
    split = slim.join(F.broadcast(heads), "__digest", "left") if winners else slim.withColumns({"__n": F.lit(None).cast("long"), "__keep": F.lit(None).cast("long"), "__kept_row": F.lit(None).cast("long")})
    out = lambda keep, n, kept: [F.col("__id").alias(id_col), keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("__digest").alias("text_sha256")]
    settled = split.filter("__n is not null").select(*out(F.col("__keep"), F.col("__n"), F.col("__row") == F.col("__kept_row")))
    rest = split.filter("__n is null").select("__id", "__digest", "__row")
    groups = cut(rest.groupBy("__digest").agg(F.count("*").alias("__size"), best.alias("__best")).filter("__size > 1"))
    joined = rest.join(fitting(groups, 160), "__digest", "left")
    alone = F.col("__size").isNull()
    keep, kept = F.when(alone, F.col("__id")).otherwise(F.col("__best.id")), alone | (F.col("__row") == F.col("__best.__row"))
    return settled.unionByName(joined.select(*out(keep, F.coalesce("__size", F.lit(1)), F.coalesce(kept, F.lit(True)))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 1024) -> DataFrame:
    """``docs`` without the rows whose text an equal text with a larger id repeats; all columns stay.

    Rows are told apart by id and digest; repeated rows leave one. Null ids and texts follow ``exact_dedup``.
    """
    verdict = exact_dedup(docs, id_col, text_col, tracked).select(F.col(id_col).alias("__i"), F.unhex("text_sha256").alias("__h"), "kept")
    return keep_rows(docs, verdict, id_col, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)))


SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents) d
JOIN (SELECT sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h,
             max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g USING (h)
"""
