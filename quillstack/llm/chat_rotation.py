"""Multi-party perspective rotation of dialogues (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import buckets_for, cut

#: Characters after which a rendering goes on in a further row, and messages of a dialogue that one task renders whole.
PIECE_CHARS, WHOLE_MESSAGES = 1 << 20, 1024
#: Rows of participants and of range sizes that may be broadcast.
BROADCAST_ROWS = 200_000
_LAST = 2**63 - 1
_OWN = len("<|im_start|>assistant\n")
_END = len("<|im_end|>\n")


def header(role: Column, me: Column) -> Column:
    kind = F.when(role == "system", F.lit("system")).when(role == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|im_start|>"), kind, F.lit("\n"))


def few(df: DataFrame) -> DataFrame:
    """``df``, already cut, to be broadcast if it has few rows; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shown(rows: DataFrame, m: str, at: Column, start: Column) -> DataFrame:
    """Renders ``m`` (structs with ``r`` and ``x``, in order); ``at`` is an array of their offsets in the whole rendering."""
    me, end = F.col("perspective"), F.lit("<|im_end|>\n")
    placed = rows.withColumns({"__at": at, "__start": start})
    text = F.array_join(F.transform(m, lambda e: F.concat(header(e["r"], me), e["x"], end)), "")
    mine = F.filter(F.transform(m, lambda e, i: F.when(e["r"] == me, F.concat((F.get("__at", i) + _OWN).cast("string"), F.lit("-"), (F.get("__at", i) + _OWN + F.length(e["x"]) + _END - 1).cast("string")))), lambda s: s.isNotNull())
    counted = placed.select("conv_id", "piece", "perspective", F.col("__start").alias("start"), F.size(m).cast("long").alias("n_messages"), text.alias("rendered"), mine.alias("__mine"))
    return counted.select("conv_id", "piece", "perspective", "start", "n_messages", "rendered", F.array_join("__mine", ",").alias("mask"), F.size("__mine").cast("long").alias("n_trained"))


def rotate(dialogues: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_chars: int = PIECE_CHARS, whole_messages: int = WHOLE_MESSAGES) -> DataFrame:
    """Each whole dialogue for each of its participants: ``conv_id, piece, perspective, start, n_messages, rendered, mask, n_trained``.

    The participant's messages are the assistant's, system messages stay, and everyone else is a named user. ``mask``
    lists the character ranges to train on (the participant's texts with their end marks) as ``from-to,from-to``.
    Participants are all who speak anywhere in the dialogue. Messages stand in order of turn (null last), role and text.

    A rendering is one row, ``piece`` 0. Only one of over ``piece_chars`` characters goes on in rows of its own: a
    message belongs to the piece in which its offset falls; ``start`` and ``mask`` count from the beginning of the
    whole rendering, so pieces joined in order are the dialogue. Dialogues of over ``whole_messages`` messages are dealt
    by ranges of their order; sums by range give each message its offset, so no task holds more than a range or a piece.

    Defined cases: a null text is empty, a null role is ``unknown``, null ids form one dialogue, repeated messages all
    stay, a dialogue of system messages only has no perspective, ``<|`` in a text or role becomes ``< |``, an empty
    table gives an empty result, and further columns are ignored.
    """
    clean = lambda c: F.replace(c.cast("string"), F.lit("<|"), F.lit("< |"))
    rows = dialogues.select(F.col(conv).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(_LAST)).alias("t"), clean(F.coalesce(F.col(role), F.lit("unknown"))).alias("r"), clean(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    others = F.length(header(F.col("r"), F.lit(None).cast("string"))) + F.length("x") + _END  # as anyone's but the speaker's own
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(others).alias("chars"))
    large = cut(sizes.filter((F.col("n") > whole_messages) | (F.col("chars") > piece_chars)).select(F.col("conv_id").alias("__c")))
    here = F.col("conv_id").eqNullSafe(F.col("__c"))
    some = not large.isEmpty()
    small = rows.join(few(large), here, "left_anti") if some else rows

    group = small.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "r", "x"))).alias("m"))
    people = F.array_distinct(F.filter(F.transform("m", lambda e: e["r"]), lambda r: r != "system"))
    each = group.select("conv_id", F.lit(0).cast("long").alias("piece"), F.explode(people).alias("perspective"), "m")
    width = lambda e: F.length(header(e["r"], F.col("perspective"))) + F.length(e["x"]) + _END
    starts = F.aggregate("m", F.array(F.lit(0).cast("long")), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + width(e))))
    whole = shown(each, "m", starts, F.lit(0).cast("long"))
    return whole.unionByName(in_pieces(rows.join(few(large), here, "left_semi"), others, piece_chars)) if some else whole


def in_pieces(rows: DataFrame, others: Column, piece_chars: int) -> DataFrame:
    """``rotate`` for dialogues of any length."""
    order = ["t", "r", "x", "row"]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # tells repeated messages apart, so they spread over ranges
    dealt = cut(numbered.repartitionByRange(buckets_for(rows), "conv_id", *order).withColumns({"range": F.spark_partition_id(), "n": others.cast("long"), "own": (F.length("x") + _OWN + _END).cast("long")}))
    who = cut(dealt.filter("r <> 'system'").select(F.col("conv_id").alias("__c"), F.col("r").alias("perspective")).distinct())
    total = dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    less = dealt.filter("r <> 'system'").groupBy(F.col("conv_id").alias("__d"), F.col("range").alias("__r"), F.col("r").alias("__p")).agg(F.sum(F.col("n") - F.col("own")).alias("less"))
    both = total.join(few(who), F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "range", "perspective", "n")
    sized = both.join(less, F.col("conv_id").eqNullSafe(F.col("__d")) & (F.col("range") == F.col("__r")) & (F.col("perspective") == F.col("__p")), "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    before = W.partitionBy("conv_id", "perspective").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = cut(sized.select(F.col("conv_id").alias("__d"), F.col("range").alias("__r"), F.col("perspective").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")))

    each = dealt.join(few(who), F.col("conv_id").eqNullSafe(F.col("__c"))).withColumn("n", F.when(F.col("r") == F.col("perspective"), F.col("own")).otherwise(F.col("n")))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("conv_id", "perspective", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("inside", inside).join(few(starts), F.col("conv_id").eqNullSafe(F.col("__d")) & (F.col("range") == F.col("__r")) & (F.col("perspective") == F.col("__p")))
    at = placed.withColumn("at", F.col("from") + F.col("inside")).withColumn("piece", F.floor(F.col("at") / piece_chars))
    pieces = at.groupBy("conv_id", "piece", "perspective").agg(F.array_sort(F.collect_list(F.struct("at", "r", "x"))).alias("m"))
    return shown(pieces, "m", F.col("m.at"), F.element_at("m", 1)["at"])


SQL = f"""
WITH c AS (SELECT conv_id, coalesce(turn, {_LAST}) AS t, replace(coalesce(role, 'unknown'), '<|', '< |') AS r, replace(coalesce(text, ''), '<|', '< |') AS x, row_number() OVER () AS row FROM conversations),
who AS (SELECT DISTINCT conv_id, r AS me FROM c WHERE r <> 'system'),
h AS (SELECT c.*, me, concat('<|im_start|>', CASE WHEN r = 'system' THEN 'system' WHEN r = me THEN 'assistant' ELSE concat('user name=', r) END, chr(10)) AS head
      FROM c JOIN who ON c.conv_id IS NOT DISTINCT FROM who.conv_id),
o AS (SELECT *, CAST(coalesce(sum(length(head) + length(x) + 11) OVER (PARTITION BY conv_id, me ORDER BY t, r, x, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM h)
SELECT conv_id, off // {PIECE_CHARS} AS piece, me AS perspective, min(off) AS start, count(*) AS n_messages, string_agg(concat(head, x, '<|im_end|>', chr(10)), '' ORDER BY off) AS rendered,
       coalesce(string_agg(CASE WHEN r = me THEN concat(CAST(off + length(head) AS VARCHAR), '-', CAST(off + length(head) + length(x) + 10 AS VARCHAR)) END, ',' ORDER BY off), '') AS mask,
       count(*) FILTER (WHERE r = me) AS n_trained
FROM o GROUP BY conv_id, off // {PIECE_CHARS}, me
"""
