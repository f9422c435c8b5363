"""Registered corpus queries against DuckDB, and the pipeline against brute force."""

import collections

import corpus_pipeline
import public_tokenizers
import pytest

from quillstack.llm import decontaminate, language_id, packing, queries
from tests.conftest import SF, comparable
from tests.llm.test_operators import brute_links, check_packing


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert comparable(queries.QUERIES[name](spark, SF).toPandas()) == comparable(duck.execute(queries.ORACLE_SQL[name]).df())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    known = stages[names[0]](spark, docs, SF)
    assert known.columns == docs.columns and known.count() >= 0.99 * docs.count()

    unique = stages[names[1]](spark, known, SF)
    last = {}
    for r in known.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(last.values())

    apart = stages[names[2]](spark, unique, SF)
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = collections.defaultdict(list)
    for i, (own, (_, text)) in enumerate(zip(brute_links(rows), rows, strict=True)):
        words[tuple(decontaminate.words(text))].append(i)
        for j in own:
            parent[root(i)] = root(j)
    for own in words.values():
        for i in own:
            parent[root(i)] = root(own[0])
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    assert sorted(r.doc_id for r in apart.collect()) == sorted(min(g) for g in groups.values())

    clean = stages[names[3]](spark, apart, SF)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = decontaminate.words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in apart.collect() if not hit(r.text))
    check_packing(stages[names[4]](spark, clean, SF), clean)
    assert language_id.drop_unknown(docs.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert whole.agg({"length": "sum"}).first()[0] == sum(len(packing.encode(r.text or "", enc)) + 1 for r in clean.collect())
