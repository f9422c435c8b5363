"""Helpers that several corpus operators share: reading, cutting lineage, distributed ranks, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.lineage import cut, shared_folder, spread

__all__ = ["ascii_lower", "bounded_sample", "buckets_for", "components", "cut", "fresh", "ranked", "shared_folder", "slices", "spread", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(text: str, limit: int) -> Iterator[str]:
    """A long text in parts of about ``limit`` characters, each but the first starting with white space after none."""
    start = 0
    while len(text) - start > limit:
        end = start + limit
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def buckets_for(df: DataFrame) -> int:
    """How many parts to deal one key into: as many as the session's shuffles have, at least 16."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def bounded_sample(rows: DataFrame, key: str, id_col: str, k: int) -> DataFrame:
    """Up to ``k`` different rows of each key, those whose id has the least hash; the same rows in every run.

    Keys are counted first, and only rows under a hash bound that about 2k of a key pass are ranked, so that no task
    ranks all rows of a key. Few keys are assumed: their counts are broadcast if that fits, else joined.
    """
    counts = cut(rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")))
    chance = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    few = F.broadcast(counts) if counts.count() <= 100_000 else counts
    near = rows.join(few, F.col(key) == F.col("__key")).withColumn("__chance", chance).filter(F.col("__chance") < F.lit(float(1 << 40)) * 2 * k / F.col("__n")).distinct()
    order = W.partitionBy(key).orderBy("__chance", id_col)
    return near.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k).drop("__key", "__n", "__chance", "__k")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, rank: str = "__rank") -> DataFrame:
    """Numbers the rows of each key from 0 without gathering a key in one task.

    Rows of a key are dealt into buckets by the hash of ``spread`` (which must tell rows apart), numbered within
    their bucket by ``order``, and shifted by the size of the buckets before. ``df`` is read twice, so it should
    be cut first. The numbers are a function of the rows, not of how tasks ran.
    """
    n = buckets_for(df)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    starts = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__kb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = W.partitionBy(*keys, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__inside", F.row_number().over(inside).cast("long") - 1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__bucket") == F.col("__kb"))
    joined = numbered.join(starts, same)
    return joined.withColumn(rank, F.col("__start") + F.col("__inside")).drop("__bucket", "__kb", "__start", "__inside", *[f"__k{i}" for i in range(len(keys))])


def small_enough(pairs: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """Two longs a row, already cut: broadcast up to ``rows`` rows, beyond that joined by a shuffle."""
    return F.broadcast(pairs) if pairs.count() <= rows else pairs


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, root`` for every node of ``edges(a long, b long)``; root is the least node of its component.

    Alternates large-star and small-star steps, each an ordinary grouped join on checkpointed edges, until the
    edges no longer change; the number of steps grows with the logarithm of the longest path.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(both)
    seen = None
    for _ in range(rounds):
        near = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are cut, so that the joins below only shuffle for themselves and a hub's rows can be split or broadcast to.
        least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(near.filter("v > u").join(small_enough(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_enough(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
