"""Findings of the third round, each with a test that failed before."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import __spark_entry__
from quillstack.functions import terms
from quillstack.operators import retrieval, upgrade
from quillstack.sources import files
from quillstack.streaming import incremental
from tests.conftest import SF


@pytest.mark.parametrize("name", ["chosen_packages", "tag_priority_join", "call_sites", "module_graph"])
def test_joins_are_not_broadcast_by_estimates_from_files(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_files_of_large_packages_are_all_read(spark):
    files_ = spark.range(30_000).selectExpr("'p' AS package", "concat('docs/', id, '.md') AS file")
    assert files.plan(files_).count() == 30_000


def test_closeness_of_codes_is_told_by_the_whole_scale(spark, tmp_path):
    import numpy as np

    scale = 0.002775418711
    vector = np.array([127 * scale, 88.5000004 * scale], dtype=np.float32).tolist()
    spark.createDataFrame([(1, vector)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.close for r in __spark_entry__.queries()["quantised_vectors"](spark, str(tmp_path)).collect()] == [True]


def test_a_stream_that_begins_with_a_file_of_no_rows_is_kept(spark, tmp_path):
    feed, target = str(tmp_path / "feed"), str(tmp_path / "target")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "b")], "key long, seq long, part string")
    for some in (rows.limit(0), rows.filter("seq < 3"), rows.limit(0), rows.filter("seq = 3")):
        some.coalesce(1).write.mode("append").parquet(feed)
        incremental.maintain(incremental.stream_of(spark, feed), target, str(tmp_path / "progress"), "key", ["seq"], "part").awaitTermination(240)
    assert sorted((r.key, r.seq, r.part) for r in spark.read.parquet(target).collect()) == [(1, 3, "b"), (2, 2, "b")]


class Rows:
    """Stands for a table where only its schema is asked for: ``mapInArrow`` gives what its tasks run."""

    def __init__(self, schema):
        self.schema = T.StructType.fromDDL(schema)

    def mapInArrow(self, run, schema):
        return run


def peak_mb(run, batches):
    tracemalloc.start()
    out = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return pa.Table.from_batches(out), peak


@pytest.mark.parametrize("coded", [False, True])
def test_cosines_with_many_queries_are_held_in_blocks(spark, coded):
    rng = np.random.default_rng(7)
    own, asked = rng.normal(size=(12_000, 8)), rng.normal(size=(1_500, 8))
    queries = [(i, v.tolist()) for i, v in enumerate(asked)]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.round(unit(asked) @ unit(own).T, 9)
    best = {(q, i) for q in range(len(asked)) for i in np.argsort(-exact[q], kind="stable")[:5].tolist()}
    batches = []
    for at in range(0, len(own), 6_000):
        some, ids = own[at : at + 6_000], pa.array(range(at, at + 6_000))
        if coded:
            scale = np.abs(some).max(axis=1) / 127
            codes = np.rint(some / scale[:, None]).astype(np.int8)
            batches.append(pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(np.linalg.norm(some, axis=1))], names=["entry_id", "codes", "scale", "norm"]))
        else:
            batches.append(pa.RecordBatch.from_arrays([pa.array([0] * len(some)), ids, pa.array(some.tolist(), pa.list_(pa.float64()))], names=["cell", "entry_id", "vector"]))
    run = retrieval.within_reach(Rows("entry_id long, codes binary, scale double, norm double"), queries, 5, T.LongType()) if coded else retrieval.nearest(Rows("cell long, entry_id long, vector array<double>"), queries, 5, T.LongType())
    found, peak = peak_mb(run, batches)
    pairs = set(zip(found["question_id"].to_pylist(), found["entry_id"].to_pylist(), strict=True))
    assert best <= pairs and (coded or pairs == best) and len(found) == len(pairs)
    assert peak < 60


def test_words_that_a_task_remembers_are_bounded(spark):
    run = terms.vectors(Listed("entry_id long, text string"), {"body": {"text": 1}})
    words = ([f"w{i}x{n}" for i in range(500)] for n in range(40))
    batches = (pa.RecordBatch.from_arrays([pa.array([n]), pa.array([" ".join(w)])], names=["entry_id", "text"]) for n, w in enumerate(words))
    tracemalloc.start()
    for _ in run(batches):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak / 20_000 * terms.MEMORY < 150  # what 20,000 words take, for as many as are remembered


class Listed(Rows):
    """With a select that keeps all; ``spread`` leaves it as it is."""

    def select(self, *_):
        return self


@pytest.fixture(autouse=True)
def unspread(monkeypatch):
    whole = terms.spread
    monkeypatch.setattr(terms, "spread", lambda df: df if isinstance(df, Rows) else whole(df))


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_pairs_of_symbols_are_told_where_they_are_made(spark, monkeypatch, common):
    monkeypatch.setattr(upgrade, "COMMON", common, raising=False)
    columns = "package string, entry_id long, kind string, name string, path string, sig string, doc string, alias_of string, legacy boolean"
    of = lambda base, p, docs: [("k", base + i, "function", f"{p}{i}", f"{p}{i}", f"{p}(x{base + i})", d, None, False) for i, d in enumerate(docs)]
    words = "amber birch cedar delta ember frost grove haven ivory jewel".split()
    sets = [words[i : i + n] for i in range(8) for n in (1, 2, 3, 5, 7, 9) if i + n <= 10]
    old, new = (spark.createDataFrame(of(base, p, [" ".join(s) for s in sets]), columns) for base, p in ((0, "old"), (1000, "new")))
    rows = upgrade.rename_candidates(old, new)
    expected = {(i, 1000 + j, round(len({*a} & {*b}) / len({*a} | {*b}), 6)) for i, a in enumerate(sets) for j, b in enumerate(sets) if len({*a} & {*b}) / len({*a} | {*b}) >= 0.7}
    found = [(r.old_id, r.new_id, r.similarity) for r in rows.collect()]
    assert set(found) == expected and len(found) == len(expected)
    # After the join by words only sums of alike pairs are shuffled: nothing is joined to them again.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "old_words" not in plan.split("Join Inner")[0]
