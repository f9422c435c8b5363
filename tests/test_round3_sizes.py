"""What is shuffled and sorted stays small, with the same results."""

import re

from pyspark.sql import functions as F

from quillstack.operators import relational


def test_texts_of_blocks_that_are_made_are_not_shuffled(spark):
    rows = spark.range(200).selectExpr("id div 8 AS q", "cast(id % 8 as int) AS rank", "cast(1 + id * 7 % 50 as int) AS times")
    made = F.expr("repeat(concat('line of text ', rank, '\n'), times)")
    packed = relational.pack_blocks(rows, "q", [F.col("rank")], "block", 400, made=made)
    held = relational.pack_blocks(rows.withColumn("block", made), "q", [F.col("rank")], "block", 400)
    of = lambda df: sorted(map(tuple, df.select("q", "rank", "times", "trimmed", "block").collect()))
    assert of(packed) == of(held) and {r[3] for r in of(packed)} == {True, False}
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window") :]
    assert "__size" in below and not re.search(r"repeat\([^\n]* AS block", below)


def test_packages_of_broad_answers_are_counted_once(spark):
    from quillstack.operators import packages

    deps = spark.createDataFrame([("npm", f"kit{i:03}", "1.0.0", i % 9 > 0) for i in range(120)], "eco string, name string, version string, direct boolean")
    there = spark.createDataFrame([("npm", f"kit{i:03}", i % 3 == 0, i % 4 == 1, "note" if i % 5 == 0 else None) for i in range(120) if i % 6], "eco string, name string, fetched boolean, upstream boolean, note string")
    asked = spark.createDataFrame([(1, "nothing here"), (2, "use kit001 now"), (3, "nor here"), (3, "nor there")], "question_id long, text string")
    found = packages.broad_counts(asked, deps, there)
    first = [i for i in range(120) if i % 9 > 0][: packages.MOST_PACKAGES]
    own = [i for i in first if i % 6]
    one = (len(own), sum(i % 3 != 0 for i in own), sum(i % 3 == 0 for i in own), sum(i % 4 == 1 for i in own), sum(i % 5 == 0 for i in own), len(first) - len(own))
    assert sorted(map(tuple, found.collect())) == [(1, *one), (3, *(2 * n for n in one))]
    assert packages.broad_counts(asked, deps.limit(0), there).count() == 0
    # Questions meet one row of counts, where they met each of up to 80 packages before.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" in plan[plan.index("Cross") :]


def test_compact_inputs_are_dealt_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    from quillstack.operators import lineage

    spark.range(2000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    own = spark.read.parquet(f"{tmp_path}/t")
    tasks, size = spark.sparkContext.defaultParallelism, lineage._estimate(own)
    assert lineage.spread(own, compact=True).rdd.getNumPartitions() == tasks
    monkeypatch.setattr(lineage, "PIECE", size // (3 * tasks))
    assert lineage.spread(own, compact=True).rdd.getNumPartitions() >= 3 * tasks and lineage.spread(own).rdd.getNumPartitions() == tasks
    monkeypatch.setattr(lineage, "PIECES", 1)
    assert lineage.spread(own, compact=True).rdd.getNumPartitions() == own.rdd.getNumPartitions()


def test_sections_of_a_small_table_are_made_in_all_tasks(spark):
    from quillstack.plans import queries, source_queries  # noqa: F401  they register their queries

    from .conftest import SF

    for name in ("markdown_sections", "markdown_chunks", "component_pages"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan, name
