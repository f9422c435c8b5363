"""Summaries of graded answers: counts, index picks, floors and a table by group of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational

# Least numbers of right answers of 105, and what must not do worse than keywords alone.
FLOORS = {"fetched": 96, "hybrid": 62, "first-use-default": 88}
NO_WORSE = {"hybrid": "keyword", "fetched": "fetched-keyword"}


def summary(results: DataFrame) -> DataFrame:
    """By ``variant`` of results (``tokens, ms, passed, error, calls``): counts, mean calls, the upper median of tokens and time and the time at index int(0.95 n)."""
    counts = results.groupBy("variant").agg(F.count("*").alias("answered"), F.count_if("passed").alias("passed"), F.count_if("error").alias("errors"), F.round(F.avg("calls"), 6).alias("mean_calls"))
    ms = relational.index_pick(results, ["variant"], "ms", {"median_ms": 0.5, "p95_ms": 0.95})
    tokens = relational.index_pick(results, ["variant"], "tokens", {"median_tokens": 0.5})
    return counts.join(ms, "variant", "left").join(tokens, "variant", "left").select("variant", "answered", "passed", "errors", "mean_calls", *[F.round(c, 6).alias(c) for c in ("median_tokens", "median_ms", "p95_ms")])


def floors(passed: DataFrame) -> DataFrame:
    """``subject, rule, passed, least, ok``: which variants (``variant, passed``) reach their floor, and which do no worse than the same without vectors."""
    spark = passed.sparkSession
    least = spark.createDataFrame(list(FLOORS.items()), "variant string, least long").join(passed, "variant").select(F.col("variant").alias("subject"), F.lit("floor").alias("rule"), "passed", "least")
    pairs = spark.createDataFrame(list(NO_WORSE.items()), "variant string, keyword string").join(passed, "variant").join(passed.select(F.col("variant").alias("keyword"), F.col("passed").alias("least")), "keyword")
    both = least.unionByName(pairs.select(F.col("variant").alias("subject"), F.lit("keyword").alias("rule"), "passed", "least"))
    return both.withColumn("ok", F.col("passed") >= F.col("least"))


def by_group(results: DataFrame) -> DataFrame:
    """``variant, group, share``: right answers of all, by line of questions and for held-out ones (``line``, ``held_out``)."""
    each = results.select("variant", "passed", F.explode(F.array_compact(F.array("line", F.when(F.col("held_out"), "held-out")))).alias("group"))
    return each.groupBy("variant", "group").agg(F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("share"))


def markdown(summary_: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of a Markdown table: a variant with its counts, groups and picks, one line each."""
    parts = groups.groupBy("variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "share"))), lambda e: F.concat(e["group"], F.lit(" "), e["share"])), " · ").alias("groups"))
    cells = F.concat_ws(" | ", "variant", F.concat_ws("/", "passed", "answered"), "groups", "median_tokens", "median_ms", "p95_ms")
    return summary_.join(parts, "variant", "left").select("variant", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
