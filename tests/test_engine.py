"""Text functions, answers, upgrades and incremental maintenance."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as X
from quillstack.operators import packages, relational, retrieval, symbols, upgrade
from quillstack.plans import engine
from quillstack.plans.fixtures import frame
from quillstack.plans.index import Index
from quillstack.sources import modules
from quillstack.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("word", "want"), [("schemas", "schema"), ("validating", "validat"), ("validated", "validat"), ("validate", "validat"), ("validation", "validat"), ("class", "class"), ("immutability", "immutabl"), ("immutable", "immutabl"), ("bodies", "body"), ("boxes", "box"), ("status", "status"), ("né", "né")])
def test_stem(spark, word, want):
    assert value(spark, X.stem(F.lit(word))) == want


def test_tokens(spark):
    assert sorted(value(spark, X.tokens(F.lit("useActionState model_dump v2 XMLParser plain")))) == sorted(["use", "action", "state", "useactionstate", "model", "dump", "model_dump", "v", "2", "v2", "xml", "parser", "xmlparser", "plain"])
    assert value(spark, X.tokens(F.lit(None).cast("string"))) == []


def test_rejecting_unknown_keys_asks_for_strict(spark):
    asked = spark.createDataFrame([(1, "How do I reject unknown keys?"), (2, "unknown types"), (3, None)], "question_id long, text string")
    rows = {(r.question_id, r.term): (r.weight, r.n_full) for r in X.question_terms(asked, True).collect()}
    assert rows[(1, "strict")] == (1.0, 4) and rows[(1, "extra")][0] == 0.35 and rows[(2, "strict")][0] == 0.35
    entries = spark.createDataFrame([(1, "strictObject rejects what it does not know"), (2, "unknown values"), (3, "other things")], "entry_id long, text string")
    best = retrieval.top(retrieval.bm25(entries, asked.filter("question_id = 1"), {"text": 1}, synonyms=True), ["question_id"], 1).first()
    assert best.entry_id == 1


def test_expressions(spark):
    assert value(spark, X.redirects(F.lit("Consider `z.strictObject(A.shape)`. Use `model_validate` instead. You can use this."))) == ["strictObject", "model_validate"]
    assert value(spark, X.redirects(F.lit("You can use this"))) == []
    for line, name, member, want in [("z.object(", "object", True, True), ("z.objects(", "object", True, False), ("object(", "object", True, False), ("a::object()", "object", True, True), ("object(", "object", False, True), ("my_object", "object", False, False)]:
        assert value(spark, X.mentions(F.lit(line), F.lit(name), F.lit(member))) is want
    assert value(spark, X.legacy_file(F.lit("v3/a.ts"), F.lit(4))) and not value(spark, X.legacy_file(F.lit("src/v2/a.ts"), F.lit(1)))
    assert value(spark, X.identifiers(F.lit("how to use z.object with `after`?"))) == ["z.object", "object", "after"]
    assert value(spark, X.shape(F.lit("function load(load: x)"), F.lit("load"))) == "function _(load: x)"
    assert value(spark, X.parent(F.lit("a::B::c"))) == "a::B" and value(spark, X.parent(F.lit("a"))) == ""
    assert value(spark, X.major_of(F.lit("v14.2.0"))) == 14 and value(spark, X.major_of(F.lit("x"))) == 0


def test_specifications(spark):
    parse = packages.Spec.parse
    assert parse("npm:@tanstack/react-query@5.1.0") == packages.Spec("npm", "@tanstack/react-query", "5.1.0") and parse("py:a.b") == packages.Spec("pypi", "a.b", None)
    assert parse("pydantic==2.9.2") == packages.Spec(None, "pydantic", "2.9.2") and parse("zod@v3") == packages.Spec(None, "zod", "3")
    assert value(spark, parse("zod@3").fits(F.lit("3.23.8"))) and not value(spark, parse("zod@3").fits(F.lit("30.0.0"))) and parse("zod@3.1.0").exact() and not parse("zod@3").exact()
    assert value(spark, parse("chi").names(F.lit("go"), F.lit("github.com/go-chi/chi/v5"))) and not value(spark, parse("npm:chi").names(F.lit("go"), F.lit("x/chi"))) and value(spark, parse("py:A_b").names(F.lit("pypi"), F.lit("a-B")))


def test_upgrade(spark):
    old, new = frame(spark, "old_entries"), frame(spark, "new_entries")
    changes = {r.path: (r.change, r.new_id) for r in upgrade.diff(old, new).collect()}
    assert changes == {"parse": ("signature_changed", 21), "load": ("renamed", 22), "Box": ("deprecated", 23), "Box.open": ("renamed", 24), "gone": ("removed", None)}
    e = engine.Engine(spark, None, None, old)
    report = e.upgrade(old, new, frame(spark, "sources_text"), "'p'")
    sites = sorted((r.path, r.file, r.line) for r in report["sites"].collect())
    assert ("load", "app.ts", 1) in sites and ("load", "app.ts", 2) in sites and ("Box.open", "lib.ts", 3) in sites and not any(f == "none.ts" for _, f, _ in sites)
    assert {r.change: r.symbols for r in report["summary"].collect()} == {"signature_changed": 1, "renamed": 2, "deprecated": 1, "removed": 1}


def test_greedy_renames_consume_candidates(spark):
    rows = [("p", 1, 10, 1.0), ("p", 1, 11, 1.0), ("p", 2, 11, 0.9), ("p", 2, 10, 0.8), ("p", 3, 10, 0.7)]
    got = upgrade.renames(spark.createDataFrame(rows, "package string, old_id long, new_id long, similarity double").withColumns({"kind": F.lit("function"), "parent": F.lit("")})).collect()
    assert {(r.old_id, r.new_id) for r in got} == {(1, 11), (2, 10)}


def test_rounds_give_what_taking_turns_does(spark):
    rng = random.Random(8)
    rows = [("p", "function", str(g), o, n, rng.choice([0.7, 0.8, 0.8, 0.9, 1.0])) for g in range(6) for o in range(12) for n in range(100, 110) if rng.random() < 0.6]
    want = set()
    for g in range(6):
        taken = set()
        for o in range(12):
            free = [(s, n) for _, _, k, i, n, s in rows if k == str(g) and i == o and n not in taken]
            if free:
                taken.add(max(free)[1])
                want.add((o, max(free)[1], g))
    one = spark.createDataFrame([(f"p{g}", k, g, o, n, s) for _, k, g, o, n, s in rows], "package string, kind string, parent string, old_id long, new_id long, similarity double")
    assert {(r.old_id, r.new_id, int(r.package[1:])) for r in upgrade.renames(one).collect()} == want


def test_running_include_is_the_fold(spark):
    rng = random.Random(3)
    rows = [(k, f"f{rng.randrange(40):02}", rng.choice([0, 1, 5, 40, 60, 99, 100, 101, 500])) for k in range(12) for _ in range(30)] + [(99, "a", 1), (99, "b", 100), (99, "c", 1), (99, "d", 99), (99, "e", 1), (99, "f", 98)]
    want = []
    for k in {r[0] for r in rows}:
        total, own = 0, []
        for _, path, size in sorted(r for r in rows if r[0] == k):
            if total + size <= 100:
                total, own = total + size, [*own, (k, path, size)]
        want += own[:7]
    got = relational.running_include(spark.createDataFrame(rows, "k long, path string, size long"), "k", "path", "size", 7, 100)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert relational.running_include(spark.createDataFrame([], "k long, path string, size long"), "k", "path", "size", 7, 100).count() == 0


def test_dense_pool_and_fusion(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "entry_id long, vector array<double>")
    near = {r.entry_id: r for r in retrieval.dense(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>"), pool=3).collect()}
    assert [near[i].rank for i in (5, 4, 3)] == [0, 1, 2] and near[5].dense == 1.0 and len(near) == 3
    lex = spark.createDataFrame([(1, 3, 0), (1, 0, 1)], "question_id long, entry_id long, rank int")
    fused = {r.entry_id: r.score for r in retrieval.reciprocal_rank(lex, spark.createDataFrame(list(near.values()))).collect()}
    assert fused[3] == 1.0 and set(fused) == {0, 3, 4, 5}


def test_running_budgets(spark):
    rows = spark.createDataFrame([(1, i, "x" * n, s) for i, (n, s) in enumerate([(30, 1.0), (60, 0.5), (300, 0.4), (3, 0.2), (3, 0.9)])], "q long, rank int, text string, score double")
    assert [r.rank for r in relational.pack_budget(rows, "q", [F.col("rank")], "text", 40).orderBy("rank").collect()] == [0, 1]
    assert [r.rank for r in relational.relevance_floor(rows, "q", [F.col("rank")]).orderBy("rank").collect()] == [0, 1, 2]


def test_engine_answers(spark, tmp_path):
    readme = "# Tiny schema\nValidates values.\n\n## Strict mode\nUse `strictObject` to reject unknown keys in objects.\n\n## Changelog\nNothing yet.\n"
    code = 'def strict_object(shape):\n    """Creates a schema that rejects unknown keys."""\n\nclass Model:\n    """A model."""\n    def to_dict(self, *, exclude_none=False) -> dict:\n        """Dumps the model as a dictionary."""\n'
    found = spark.createDataFrame([("tiny", "README.md", "prose", readme), ("tiny", "tiny/core.py", "python", code), ("other", "README.md", "prose", "# Other\nConverts dates.")], "package string, file string, how string, text string")
    index = engine.Engine.build_index(found, spark.createDataFrame([("tiny", "1.2.0"), ("other", "2.0.0")], "package string, version string"))
    path = str(tmp_path / "index")
    engine.Engine.write_index(index, path)
    engine.Engine.write_index(index.filter("package = 'other'"), path)
    entries = engine.Engine.read_index(spark, path)
    assert entries.count() == index.count()
    e = engine.Engine(spark, frame(spark, "deps"), frame(spark, "sources"), entries)
    asked = spark.createDataFrame([(1, "How do I reject unknown keys?"), (2, "to_dict")], "question_id long, text string")
    hits = e.docs(asked, "tiny").orderBy("question_id", "rank").collect()
    first = {r.question_id: r for r in reversed(hits)}
    assert first[1].path in ("strict_object", "Tiny schema › Strict mode", "README.md › Tiny schema › Strict mode") and first[2].path == "Model.to_dict"
    assert all(r.package == "tiny" for r in hits) and all(sum(len(r.rendered) for r in hits if r.question_id == q) <= 3600 for q in (1, 2))
    api = {r.symbol: r for r in e.api(spark.createDataFrame([("Model.to_dict",), ("nothing",)], "symbol string")).collect()}
    assert api["Model.to_dict"].status == "exact" and api["Model.to_dict"].line == 6 and api["nothing"].status == "unresolved"
    over = {r.package: r for r in e.overview().collect()}
    assert over["tiny"].n_symbols == 3 and over["tiny"].symbols[:2] == ["Model", "strict_object"]
    status = {r.name: r.status for r in e.resolve().collect()}
    assert status["tiny-schema"] == "ready" and status["tinyrt"] == "drift" and status["missing-pkg"] == "missing" and "Typing_Extensions" not in status
    assert e.resolve("typing").first().found == "4.8.0"


VERSIONS = [("npm", "zod", "3.23.8"), ("npm", "zod", "4.0.0"), ("pypi", "zod", "9.9.9"), ("npm", "redis", "5.0.0"), ("pypi", "redis", "5.0.0")]


@pytest.fixture(scope="module")
def versions(spark):
    """Entries of one name in several versions and ecosystems, each saying which it is."""
    parts = []
    for eco, name, version in VERSIONS:
        text = f"# {name}\nHow to parse values strictly with {eco} {name} {version}, at length and in general.\n\n## Strict\nParse strictly in {eco} {version}.\n"
        code = f'def parse_strictly(value):\n    """Parses values strictly in {eco} {version}."""\n'
        files = spark.createDataFrame([(name, "README.md", "prose", text), (name, "core.py", "python", code)], "package string, file string, how string, text string")
        parts.append(engine.Engine.build_index(files, spark.createDataFrame([(eco, name, version)], "eco string, package string, version string")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.persist()


@pytest.fixture(scope="module")
def pins(spark):
    return spark.createDataFrame([("npm", "zod", "zod", "3.23.8", True), ("npm", "lodash", "lodash", "4.1.0", True)], "eco string, name string, norm_name string, version string, direct boolean")


def test_answers_come_from_the_pinned_version(spark, versions, pins):
    e = engine.Engine(spark, pins, None, versions)
    asked = spark.createDataFrame([(1, "How do I parse strictly with zod?"), (2, "parse values strictly")], "question_id long, text string")
    for package in (None, "zod", "zod@3", "npm:zod@3.23.8"):
        assert {(r.eco, r.package, r.version) for r in e.docs(asked, package).collect()} == {("npm", "zod", "3.23.8")}
    assert {r.version for r in e.docs(asked, "zod@4.0.0").collect()} == {"4.0.0"} and {r.eco for r in e.docs(asked, "pypi:zod@9.9.9").collect()} == {"pypi"}
    for package, said in (("zod@4", "pins zod 3.23.8"), ("lodas", "lodash@4.1.0"), ("redis", "several are indexed"), ("nothing", "not a dependency")):
        with pytest.raises(LookupError, match=said):
            e.docs(asked, package)
    assert {(r.eco, r.version) for r in e.docs(asked, "pypi:redis").collect()} == {("pypi", "5.0.0")}
    told = {r.question_id: (r.broad, r.searched, r.missing) for r in e.provenance(asked).collect()}
    assert told == {1: (False, ["npm:zod@3.23.8"], []), 2: (True, ["npm:zod@3.23.8"], ["npm:lodash@4.1.0"])}
    found = {r.symbol: (r.status, r.version) for r in e.api(spark.createDataFrame([("parse_strictly",), ("zod.parse_strictly()",)], "symbol string")).collect()}
    assert found == {"parse_strictly": ("exact", "3.23.8"), "zod.parse_strictly()": ("exact", "3.23.8")}
    over = {(r.eco, r.package, r.version): r.symbols for r in e.overview().collect()}
    assert set(over) == set(VERSIONS) and all(v == ["parse_strictly"] for v in over.values())


def test_an_empty_question_gives_the_overview(spark, versions, pins):
    e = engine.Engine(spark, pins, None, versions)
    rows = e.docs(spark.createDataFrame([(1, " "), (2, "parse strictly"), (3, None)], "question_id long, text string"), "zod").orderBy("question_id", "rank").collect()
    first = {r.question_id: r.rendered for r in reversed(rows)}
    assert first[1] == first[3] == "zod@3.23.8 · npm\nIndexed 1 API symbols and 2 doc sections.\nKey API: parse_strictly\n" and first[2].startswith("### ")
    assert [r.rank for r in rows if r.question_id == 1] == [0, 1, 2] and any("npm zod 3.23.8" in r.rendered for r in rows if r.question_id == 1)


def test_results_show_what_a_re_export_stands_for(spark, pins):
    files = spark.createDataFrame([("zod", "core.py", "python", 'def strict_object(shape):\n    """Rejects unknown keys."""\n')], "package string, file string, how string, text string")
    entries = engine.Engine.build_index(files, spark.createDataFrame([("npm", "zod", "3.23.8")], "eco string, package string, version string"))
    alias = entries.withColumns({"entry_id": F.lit(7).cast("long"), "kind": F.lit("re-export"), "name": F.lit("shorthand"), "path": F.lit("shorthand"), "file": F.lit("index.py"), "sig": F.lit("shorthand"), "doc": F.lit(""), "alias_of": F.lit("strict_object"), "f_name": F.lit("shorthand"), "f_prose": F.lit(""), "f_summary": F.lit("")})
    found = engine.Engine(spark, pins, None, entries.unionByName(alias)).docs(spark.createDataFrame([(1, "shorthand")], "question_id long, text string"), "zod").orderBy("rank").first()
    assert (found.entry_id, found.path, found.file, found.doc) == (7, "strict_object", "core.py", "Rejects unknown keys.")


def test_index_keeps_ecosystems_apart_and_readers_their_snapshot(spark, versions, pins, tmp_path):
    path = str(tmp_path / "index")
    names = lambda df: sorted({(r.eco, r.package, r.version) for r in df.collect()})
    redis = versions.filter("package = 'redis'")
    engine.Engine.write_index(redis.filter("eco = 'npm'"), path)
    engine.Engine.write_index(redis.filter("eco = 'pypi'"), path)
    assert names(engine.Engine.read_index(spark, path)) == [("npm", "redis", "5.0.0"), ("pypi", "redis", "5.0.0")]
    index = Index(spark, path)
    before = index.at()
    held = before.entries()
    third = engine.Engine.write_index(versions.filter("package = 'zod'"), path)
    changed = engine.Engine.write_index(redis.filter("eco = 'npm'").withColumn("doc", F.lit("changed")), path)
    assert names(held) == names(before.entries()) == [("npm", "redis", "5.0.0"), ("pypi", "redis", "5.0.0")] and held.filter("doc = 'changed'").isEmpty()
    assert names(index.at().entries()) == sorted(VERSIONS) and not index.at().entries().filter("doc = 'changed'").isEmpty()
    # A write that is killed before its last step leaves folders that nobody reads.
    versions.limit(1).withColumns({"write": F.lit("killed"), "body_len": F.lit(1).cast("long"), "head_len": F.lit(1).cast("long")}).write.partitionBy("write").mode("append").parquet(f"{path}/entries")
    assert index.at().number == changed and index.at().entries().count() == versions.count()
    back = index.rollback(third)
    assert index.at().number == back and index.at().entries().filter("doc = 'changed'").isEmpty()
    asked = spark.createDataFrame([(1, "How do I parse strictly with zod?")], "question_id long, text string")
    same = [engine.Engine(spark, pins, None, versions), engine.Engine.open(spark, path, pins, None)]
    first, second = ([(r.rank, r.entry_id, r.score) for r in e.docs(asked).orderBy("rank").collect()] for e in same)
    assert first == second and first
    plan = index.at().lists(spark.createDataFrame([("pars",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert index.vacuum(keep=1) == 2 and names(index.at().entries()) == sorted(VERSIONS) and index.numbers() == [back]
    with pytest.raises(LookupError):
        index.at(third)


def test_names_that_resemble(spark, pins):
    more = pins.unionByName(spark.createDataFrame([("go", "x.io/a/zo", "zo", "v1", True), ("npm", "", "", "0", False)], pins.schema))
    asked = spark.createDataFrame([("ZO",), ("lodashes",), ("",), ("q",)], "asked string")
    got = {}
    for r in packages.similar(more, asked).collect():
        got.setdefault(r.asked, []).append(r.id.split(":")[1].split("@")[0])
    assert sorted(got["ZO"]) == ["x.io/a/zo", "zod"] and sorted(got["lodashes"]) == ["", "lodash"] and len(got[""]) == 4 and "q" not in got


def test_modes_of_fusion_by_scope(spark):
    rows = [(c, 10 * c + i, "function", f"name{i}", "upstream:x.md" if c == 2 else "a.py", f"text number{i} about things") for c in (1, 2, 3) for i in range(4)]
    entries = spark.createDataFrame(rows, "cell long, entry_id long, kind string, name string, file string, doc string").withColumns({"package": F.concat(F.lit("p"), F.col("cell").cast("string")), "path": F.col("name"), "sig": F.lit(""), "legacy": F.lit(False), "major": F.lit(1).cast("long")})
    vectors = spark.createDataFrame([(e, [1.0, float(e % 10)]) for _, e, *_ in rows if e < 30], "entry_id long, vector array<double>")
    asked = spark.createDataFrame([(q, "text about things") for q in (1, 2, 3)] + [(4, "name2")], "question_id long, text string")
    cells = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 1, 1)], "question_id long, scope long, cell long")
    near = spark.createDataFrame([(q, [0.0, 1.0]) for q in (1, 2, 3, 4)], "question_id long, vector array<double>")
    found = retrieval.hybrid(entries, asked, {"name": 8, "doc": 2}, {"name": 2}, vectors, near, cells=cells).collect()
    assert all(r.package == f"p{r.cell}" for r in found)
    best = {q: max((r.score, r.entry_id) for r in found if r.question_id == q)[1] for q in (1, 2, 3, 4)}
    assert best[2] == 23 and best[4] == 12  # scores mixed with upstream docs: the nearest vector; a clear leader by words stays
    lex = {r.entry_id: r.score for r in retrieval.hybrid(entries, asked, {"name": 8, "doc": 2}, {"name": 2}, cells=cells).filter("question_id = 3").collect()}
    assert {r.entry_id: r.score for r in found if r.question_id == 3} == lex  # a package without vectors


def test_stream_keeps_the_same_state_as_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 17, i, f"v{i}", i % 3) for i in range(300)], "key long, seq long, v string, part long")
    feed, target = str(tmp_path / "feed"), str(tmp_path / "state")
    rows.withColumn("part", F.col("key") % 3).repartition(5).write.parquet(feed)
    query = incremental.maintain(incremental.stream_of(spark, feed), target, str(tmp_path / "cp"), "key", ["seq"], "part")
    query.awaitTermination(240)
    want = incremental.latest(spark.read.parquet(feed), "key", ["seq"])
    assert sorted(map(tuple, spark.read.parquet(target).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    moved, places = str(tmp_path / "moved"), str(tmp_path / "places")
    spark.createDataFrame([(i % 5, i, f"v{i}", (i // 5) % 4) for i in range(40)], "key long, seq long, v string, part long").repartitionByRange(8, "seq").write.parquet(moved)
    incremental.maintain(incremental.stream_of(spark, moved), places, str(tmp_path / "cp2"), "key", ["seq"], "part").awaitTermination(240)
    assert sorted((r.key, r.seq, r.part) for r in spark.read.parquet(places).collect()) == [(k, 35 + k, 3) for k in range(5)]
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'b'")
    assert sorted((r.k, r.n) for r in incremental.window_counts(events, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_engine_answers_within_an_import(spark):
    sources = {
        "index.d.ts": "/** Parses a value strictly. */\nexport declare function parse(x: string): Value;\nexport declare class Value {\n  /** Rejects unknown keys. */\n  strict(): Value;\n}\n",
        "fresh/index.d.ts": "/** Parses a value in the new way. */\nexport declare function parse(x: string, how: Mode): Value;\n", "inner/hidden.d.ts": "/** Parses what nobody may see. */\nexport declare function parse(): never;\n",
    }
    readme = "# Kit\nEverything about parsing values.\n\n## Parse\n```ts\nimport { parse } from 'kit'\n```\nParse strictly with it.\n\n## Fresh parse\n```ts\nimport { parse } from 'kit/fresh'\n```\nParse in the new way.\n"
    rows = [("kit", f, "ts", t) for f, t in sources.items()] + [("kit", "README.md", "prose", readme), ("other", "README.md", "prose", "# Other\nParse values, parse values.\n")]
    found = spark.createDataFrame(rows, "package string, file string, how string, text string")
    typed = found.filter("how = 'ts'")
    roots = modules.roots(spark.createDataFrame([("kit", '{"exports": {".": "./index.d.ts", "./fresh": "./fresh/index.d.ts"}}')], "package string, manifest string"), typed)
    entries = engine.Engine.build_index(found, spark.createDataFrame([("npm", "kit", "1.2.0"), ("npm", "other", "1.0.0")], "eco string, package string, version string"), by_file=True).persist()
    deps = spark.createDataFrame([("npm", "kit", "kit", "1.2.0", True), ("npm", "other", "other", "1.0.0", True)], "eco string, name string, norm_name string, version string, direct boolean")
    e = engine.Engine(spark, deps, frame(spark, "sources"), entries, roots=roots.persist(), graph={k: v.persist() for k, v in modules.graph(typed).items()})
    asked = spark.createDataFrame([(1, "How do I call parse(x) of kit?"), (2, "the new way of kit/fresh to parse, kit"), (3, "parse values")], "question_id long, text string")
    hits = e.docs(asked).orderBy("question_id", "rank").collect()
    of = lambda q: [r.file for r in hits if r.question_id == q]
    assert of(1)[0] == "index.d.ts" and [r.called for r in hits if r.question_id == 1][0] == 1 and not any(f.startswith(("fresh/", "inner/")) for f in of(1))
    assert "fresh/index.d.ts" in of(2) and "index.d.ts" not in of(2) and all("kit'" not in r.doc for r in hits if r.question_id == 2)
    assert {r.package for r in hits if r.question_id == 3} == {"kit", "other"} and {r.package for r in hits if r.question_id == 1} == {"kit"}
    assert {r.package for r in e.docs(asked.filter("question_id = 3"), "npm:kit/fresh@1").collect()} == {"kit"}
    status = {r.symbol: r.status for r in e.exported(spark.createDataFrame([("kit", "kit", "Value.strict"), ("kit", "kit", "hidden")], "package string, import string, symbol string")).collect()}
    assert status == {"Value.strict": "exact", "hidden": "not_exported"}


def test_blocks_are_cut_to_the_budget(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 90 + "\n"), (1, 1, "```js\n" + "line of code\n" * 60), (1, 2, "x"), (2, 0, "y\n" * 10)], "q long, rank int, block string")
    out = {(r.q, r.rank): (r.block, r.trimmed) for r in relational.pack_blocks(rows, "q", [F.col("rank")], "block", 200).collect()}
    assert set(out) == {(1, 0), (1, 1), (2, 0)} and out[(1, 1)][1] and out[(1, 1)][0].endswith("```\n[cut to fit the budget]\n") and len(out[(1, 1)][0]) < 560
    assert not out[(1, 0)][1] and out[(2, 0)][0] == "y\n" * 10


def test_publishing_replaces_a_table_as_a_whole(spark, tmp_path):
    target = str(tmp_path / "table")
    incremental.publish(spark.range(5), target)
    incremental.publish(spark.range(7, 9), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [7, 8] and [p.name for p in tmp_path.iterdir()] == ["table"]
