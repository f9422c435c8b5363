"""Keyword ranks of many questions: lists that questions share, entries with seldom terms by themselves, and only what is asked for."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import retrieval as R
from quillstack.plans.engine import Engine


def texts(n, seed, most=12):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(60)], k=rng.randint(1, most)))) for i in range(n)]


@pytest.mark.parametrize("seldom", [0, 20, 10_000])
def test_pools_of_shared_lists_and_seldom_terms_are_those_of_all_pairs(spark, monkeypatch, seldom):
    monkeypatch.setattr(R, "SELDOM", seldom)
    monkeypatch.setattr(R, "LEXICAL_POOL", 30)
    monkeypatch.setattr(R, "QUESTIONS_TOGETHER", 4)
    own = spark.createDataFrame(texts(500, 3), "entry_id long, text string").withColumn("cell", F.col("entry_id") % 3)
    questions = spark.createDataFrame(texts(40, 4, 4), "question_id long, text string")
    q = R.cut(X.question_terms(questions, True))
    made = R.index(own, {"body": {"text": 2}, "head": {"text": 1}}, q).join(own.select("entry_id", "cell"), "entry_id")
    scopes = {0: [0], 1: [0, 1, 2]}
    cells = spark.createDataFrame([(i, i % 2, c) for i in range(40) for c in scopes[i % 2]], "question_id long, scope long, cell long")
    post = R.Postings.of(made, q)
    found = {(r.question_id, r.entry_id): r.lex for r in R.lexical_in(post, q, cells, R.scope_stats(post, q, cells)).collect()}
    expected = {}
    for scope, inside in scopes.items():
        some, asked = made.filter(F.col("cell").isin(inside)), q.filter(F.col("question_id") % 2 == scope)
        for g, share in (("body", 0.75), ("head", 0.25)):
            for r in R.normalized(R.bm25_of(R.postings(some, g), some.select(F.col(f"{g}_len").alias("len")), asked), 30).collect():
                expected[r.question_id, r.entry_id] = expected.get((r.question_id, r.entry_id), 0) + share * r.score
    assert found.keys() == expected.keys() and all(abs(expected[p] - s) < 1e-8 for p, s in found.items())


def library(spark, n=400):
    rows = [(i, f"fn{i}" if i % 3 else f"C{i}", f"red gear sized {i % 7} number {i}. Use `fn{i + 1}` instead." if i % 11 == 0 else f"red gear sized {i % 7} number {i}", f"src/f{i % 5}.ts") for i in range(n)]
    own = spark.createDataFrame(rows, "entry_id long, name string, doc string, file string")
    return own.select(F.lit("p").alias("package"), "entry_id", F.when(F.col("entry_id") % 3 == 0, "class").otherwise("function").alias("kind"), "name", F.col("name").alias("path"), "file", F.lit("").alias("sig"), "doc", F.lit(None).cast("string").alias("alias_of"), (F.col("entry_id") % 9 == 0).alias("legacy"), F.lit(1).alias("line"), F.lit(1).cast("long").alias("major"))


def test_questions_that_are_alike_are_scored_once_and_no_more_is_passed_on_than_asked_for(spark, monkeypatch):
    monkeypatch.setattr(R, "SELDOM", 5)
    entries = library(spark)
    questions = spark.createDataFrame([(i, f"red gear sized number {i}: what is fn{i}") for i in range(60)], "question_id long, text string")
    asked, scores = [], R.best_scores

    def counted(rows, questions_, *rest):
        asked.append(questions_.select("question_id").distinct().count())
        return scores(rows, questions_, *rest)

    monkeypatch.setattr(R, "best_scores", counted)
    best = lambda df: {(r.question_id, r.rank, r.entry_id, r.s) for r in R.top(df.withColumn("score", F.round("score", 9)), ["question_id"], 4).withColumn("s", F.round("score", 6)).collect()}
    every = R.hybrid(entries, questions, {"name": 8, "doc": 2}, {"name": 2})
    few = R.hybrid(entries, questions, {"name": 8, "doc": 2}, {"name": 2}, wanted=R.Wanted(4))
    assert best(few) == best(every) and len(best(few)) == 240
    assert max(asked) <= 20  # kinds of 60 questions: by numbers that sizes have too, and by fields
    assert few.count() <= 60 * (4 + 2 * R.REDIRECT_PROBES) < every.count() / 3


def test_of_entries_that_agree_only_the_best_is_passed_on_and_weak_ones_are_not(spark):
    entries = library(spark)
    questions = spark.createDataFrame([(i, f"red gear sized 3 number {i}") for i in range(9)], "question_id long, text string")
    whole = R.hybrid(entries, questions, {"name": 8, "doc": 2}, {"name": 2}).join(entries.select("entry_id", "file"), "entry_id").withColumn("score", F.round("score", 9))
    few = R.hybrid(entries, questions, {"name": 8, "doc": 2}, {"name": 2}, wanted=R.Wanted(50, ("file",), 0.3)).join(entries.select("entry_id", "file"), "entry_id").withColumn("score", F.round("score", 9))

    def shown(df):
        once = R.top(df, ["question_id", "file"], 1).drop("rank")
        ranked = R.top(once, ["question_id"], 50)
        first = ranked.filter("rank = 0").select("question_id", F.col("score").alias("first"))
        return {(r.question_id, r.entry_id) for r in ranked.join(first, "question_id").filter("rank < 3 or score >= 0.3 * first").collect()}

    assert shown(few) == shown(whole)


def test_answers_are_made_of_no_more_ranks_than_a_budget_can_show(spark, monkeypatch):
    entries = library(spark).withColumns({"eco": F.lit("npm"), "version": F.lit("1.0.0"), "parents": F.array(F.col("entry_id").cast("int")), "imports": F.array().cast("array<string>"), "line": F.col("entry_id").cast("int")})
    deps = spark.createDataFrame([("npm", "p", "p", "1.0.0", True)], "eco string, name string, norm_name string, version string, direct boolean")
    questions = spark.createDataFrame([(i, f"red gear sized 3 number {i} of fn{i}") for i in range(5)], "question_id long, text string")
    hybrid, made = R.hybrid, []

    def counted(*args, wanted, **more):
        found = R.cut(hybrid(*args, wanted=wanted if bounded else None, **more))
        made.append(found.count())
        return found

    monkeypatch.setattr(R, "hybrid", counted)
    answers = []
    for bounded in (True, False):
        found = Engine(spark, deps, None, entries, body={"name": 8, "doc": 2}, head={"name": 2}).docs(questions, tokens=300)
        answers.append({(r.question_id, r["rank"], r.path, r.rendered, r.trimmed) for r in found.collect()})
    assert answers[0] == answers[1] and len(answers[0]) > 5
    assert made[0] <= 5 * (15 + 2 * R.REDIRECT_PROBES) < made[1] / 4  # a block has 60 characters at least, a budget 900
