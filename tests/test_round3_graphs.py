"""Export graphs that are deep: rounds and rows that grow with the depth that is asked for, and results by brute force."""

import pytest
from pyspark.sql import functions as F

from quillstack.operators import exports


@pytest.fixture
def cuts(monkeypatch):
    made, cut = [], exports.cut
    monkeypatch.setattr(exports, "cut", lambda df: made.append(out := cut(df)) or out)
    return made


def star_frame(spark, pairs):
    return spark.createDataFrame([("k", a, b) for a, b in pairs], "package string, file string, target string")


#: A long chain with a dead end at each file and a branch that joins it, a ring, a chain into the ring, and a diamond.
PAIRS = (
    [(f"c{i}", f"c{i + 1}") for i in range(400)] + [(f"c{i}", f"leaf{i}") for i in range(401)] + [(f"b{i}", f"b{i + 1}") for i in range(30)] + [("b30", "c300")]
    + [(f"r{i}", f"r{(i + 1) % 150}") for i in range(150)] + [(f"t{i}", f"t{i + 1}") for i in range(5)] + [("t5", "r7"), ("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d3", "c395")]
)


def longest(pairs):
    """The longest way on from each file; none for those in or before a cycle."""
    onward, found = {}, {}
    for a, b in pairs:
        onward.setdefault(a, []).append(b)
    files = {f for p in pairs for f in p}
    for _ in range(len(files)):
        new = {f: max((found[t] + 1 for t in onward.get(f, [])), default=0) for f in files - found.keys() if all(t in found for t in onward.get(f, []))}
        if not new:
            return onward, found
        found |= new
    return onward, found


def test_heights_take_no_longer_than_the_depth_that_is_asked_for(spark, cuts):
    told, jumps = exports.heights(star_frame(spark, PAIRS))
    _, expected = longest(PAIRS)
    assert {r.file: r.h for r in told.collect()} == {f: h for f, h in expected.items() if h <= exports.DEPTH}
    assert jumps.selectExpr("max(w)").first()[0] <= exports.DEPTH
    assert len(cuts) < 30


def test_a_surface_of_128_steps_takes_few_rounds_of_its_own_files_only(spark, cuts):
    ends = {"near": "c395", "most": "c273", "over": "c271", "joins": "b29", "ring": "r0", "into": "t0", "both": "d0", "leaf": "leaf3"}
    ends |= {f"c{i}": f"c{i}" for i in (271, 272, 273)}
    roots = spark.createDataFrame([("k", i, f) for i, f in ends.items()], "package string, import string, file string")
    files = sorted({f for p in PAIRS for f in p})
    modules = spark.createDataFrame([("k", f, False, None) for f in files], "package string, file string, incomplete boolean, assignment string")
    exported = spark.createDataFrame([("k", f, f"v{f}") for f in files], "package string, file string, name string")
    found = {r["import"]: set(r["names"]) for r in exports.surface(roots, {"stars": star_frame(spark, PAIRS), "modules": modules, "exports": exported}).collect()}
    onward, height = longest(PAIRS)
    expected = {}
    for name, start in ends.items():
        if height.get(start, 1 << 20) <= exports.DEPTH:
            seen = {start}
            while more := {t for f in seen for t in onward.get(f, [])} - seen:
                seen |= more
            expected[name] = {f"v{f}" for f in seen}
    assert found == expected and {"near", "most", "joins", "both", "leaf", "c273"} <= expected.keys() and not {"over", "ring", "into", "c271"} & expected.keys()
    assert len(cuts) < 40  # 52 before, when chains of any length were followed twice


def test_files_of_deep_imports_are_reached_without_holding_all_ways(spark, cuts):
    ends = {"first": "c0", "near": "c395", "joins": "b29", "ring": "r0", "into": "t0", "both": "d0", "leaf": "leaf3", "nowhere": "none"}
    roots = spark.createDataFrame([("k", i, f) for i, f in ends.items()], "package string, import string, file string")
    found = {}
    for r in exports.reach(roots, star_frame(spark, PAIRS)).collect():
        assert r["file"] not in found.setdefault(r["import"], set())
        found[r["import"]].add(r["file"])
    onward, _ = longest(PAIRS)
    for name, start in ends.items():
        seen = {start}
        while more := {t for f in seen for t in onward.get(f, [])} - seen:
            seen |= more
        assert found[name] == seen, name
    assert max(c.count() for c in cuts) < 2 * len(PAIRS)  # not so when all doubled ways were one table


def test_a_loop_of_self_joins_keeps_estimates_short(spark):
    from quillstack.operators.lineage import _estimate, cut

    now = cut(spark.range(40).selectExpr("cast(id as string) AS file", "cast(least(id + 1, 39) as string) AS target", "array(id) AS own", "struct('k' AS name) AS package"))
    for _ in range(12):
        now = cut(now.join(now.select("package", F.col("file").alias("target"), F.col("target").alias("far")), ["package", "target"]).select("file", F.col("far").alias("target"), "own", "package"))
        assert _estimate(now).bit_length() < 1_000  # it doubles with each round where it is kept
    assert {(r.file, r.target, tuple(r.own), r.package.name) for r in now.collect()} == {(str(i), "39", (i,), "k") for i in range(40)}
