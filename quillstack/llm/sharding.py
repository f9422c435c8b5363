"""Sharding by balanced label propagation (DataFrame functions only)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, ranked


def pick(limits: list[int], rank: Column) -> Column:
    """How many of the ascending ``limits`` are at most ``rank``."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda x: x <= rank))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def flows(moves: dict[tuple[int, int], int], room: list[int]) -> list[float]:
    """The share of each shard's wished inflow that it admits, given its room and what leaves it in turn."""
    shards = range(len(room))
    wish = [sum(n for (_, t), n in moves.items() if t == s) for s in shards]
    share = [0.0] * len(room)
    for _ in range(100):
        gone = [sum(n * share[t] for (f, t), n in moves.items() if f == s) for s in shards]
        share = [min(1.0, max(0.0, room[s] + gone[s]) / wish[s]) if wish[s] else 1.0 for s in shards]
    return share


def propagate(cells: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Balanced label propagation over ``digest, shard, n``: a group's rows in a shard, in place of its edges.

    In each round every cell wishes to follow its neighbours into the shard where its group has most rows (ties by
    hash), or out of a full shard into one of its group's others that has room; wishes between each two shards are counted (at most shards^2 numbers), and quotas admit a share of them so
    that no shard exceeds its size. The state is checkpointed each round.
    """
    group = W.partitionBy("digest")
    for k in range(rounds):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        weight = lambda n, s: F.struct(n.alias("n"), F.xxhash64("digest", s).alias("h"), s.alias("s"))
        open_ = F.element_at(F.array(*[F.lit(r > 0) for r in room]), F.col("shard") + 1)
        wish = cells.withColumn("best", F.max(F.when(open_ | (F.lit(k) == 0), weight(F.col("n"), F.col("shard")))).over(group))
        fits = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("best.s") + 1) >= F.col("n")
        follows = (F.col("best") > weight(F.col("n"), F.col("shard"))) | (~open_ & fits)
        wish = wish.withColumn("to", F.when((F.col("best.s") != F.col("shard")) & follows, F.col("best.s")))
        moves = {(r["shard"], r["to"]): r["n"] for r in wish.filter("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        if not moves:
            break
        share = F.element_at(F.array(*[F.lit(float(x)) for x in flows(moves, room)]), F.col("to") + 1)
        # Parts are rounded by chance; the few rows by which a quota may be exceeded are placed like unlinked ones.
        chance = F.pmod(F.xxhash64("digest", "shard", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        gone = F.when(F.col("to").isNull(), F.lit(0)).otherwise(F.least(F.col("n"), F.floor(F.col("n") * share + chance)))
        parts = wish.withColumn("gone", gone.cast("long")).select("digest", F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("gone")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("gone").alias("n")))).alias("c"))
        cells = cut(parts.select("digest", "c.shard", "c.n").filter("n > 0").groupBy("digest", "shard").agg(F.sum("n").alias("n")))
    return cells


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; the law is ``rows``: counts at most one apart.

    Documents with equal texts are linked. Label propagation under quotas brings linked documents together; documents
    without a link then fill each shard to exactly its quota, as do rows beyond a quota that a group larger than a shard
    leaves. Rounds end when nothing moves; a group
    larger than a shard fills one after another, so there are at most 16 rounds more than shards. Only sizes by shard (at most shards^2 numbers) reach the driver. All ranks are taken in hash buckets, so a
    group of any size is spread over tasks.

    Defined cases: a null text has no bytes and is linked with empty texts; null ids and repeated rows are rows like
    others; an empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    start = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")
    quota = quotas(slim.count(), shards)
    first = slim.groupBy("digest", start.alias("shard")).agg(F.count("*").alias("n"))
    first = first.withColumn("all", F.sum("n").over(W.partitionBy("digest"))).filter("all > 1").drop("all")
    cells = propagate(cut(first), quota, shards + 16)

    upto = F.sum("n").over(W.partitionBy("digest").orderBy("shard"))
    plan = cells.withColumn("upto", upto).groupBy(F.col("digest").alias("g")).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("cells"))
    joined = cut(slim.join(plan, F.col("digest") == F.col("g"), "left").drop("g"))
    linked = ranked(joined.filter("cells is not null").select("row", "digest", "cells"), ["digest"], [F.col("row")], F.col("row"), "r")
    placed = cut(linked.select("row", F.element_at(F.filter("cells", lambda c: c["upto"] > F.col("r")), 1)["shard"].alias("shard")))
    slots = cut(ranked(placed, ["shard"], [F.col("row")], F.col("row"), "slot").select("row", "shard", "slot"))
    inside = F.col("slot") < F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard") + 1)

    load = {r["shard"]: min(r["n"], quota[r["shard"]]) for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    limits = list(accumulate(q - load.get(s, 0) for s, q in enumerate(quota)))
    rest = cut(joined.filter("cells is null").select("row").unionByName(slots.filter(~inside).select("row")).withColumn("one", F.lit(0)))
    fill = ranked(rest, ["one"], [F.col("row")], F.col("row"), "r").withColumn("shard", pick(limits, F.col("r")))
    shift = F.element_at(F.array(*[F.lit(load.get(s, 0) - (limits[s - 1] if s else 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
    where = slots.filter(inside).unionByName(fill.select("row", "shard", (F.col("r") + shift).alias("slot")))
    return joined.join(where, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
