"""Centroid clustering, phrase collocations and shingle dedup against brute force, and links within large buckets."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import ball_kmeans, collocations, common, near_duplicates, shingle_dedup

WIDE = "doc_id long, text string, lang string, source string, digest string, row long, id long, node long, block long, cluster int"


def wide(i, text, lang="en"):
    return (i, text, lang, "s", "x", 7, 8, 9, 10, 11)


# Centroid clustering


def brute_kmeans(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for _, _, v in hashed[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, v long, cluster string, sums long"


def clustered(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in ball_kmeans.cluster(df, **more).collect()), key=repr)


def test_ball_kmeans_is_lloyds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * rng.choice([0.01, 1, 30]) + rng.choice([0, 2], size=64)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]), (2005, [1.0] * 63 + [float("-inf")]), (2006, [-0.0] * 64)]
    assert clustered(spark, rows) == brute_kmeans(rows)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(5)]
    assert clustered(spark, same) == brute_kmeans(same) and {r[1] for r in clustered(spark, same)} == {0}
    assert clustered(spark, []) == [] and clustered(spark, [(1, [1.0])]) == []
    huge = [(i, [1e5 * (-1) ** (i + j) for j in range(64)]) for i in range(12)]
    assert clustered(spark, huge) == brute_kmeans(huge)
    with pytest.raises(Exception, match="beyond 64 bits"):
        clustered(spark, [(1, [1e30] * 64)])


def test_balls_meet_only_neighbours():
    centroids = np.array([[0] * 64, [10] + [0] * 63, [1000] + [0] * 63], dtype=np.int64)
    balls = ball_kmeans.Balls.of(centroids, [36, 36, -1])
    assert balls.neighbours[0].tolist() == [1] and balls.neighbours[1].tolist() == [0] and balls.neighbours[2].tolist() == []
    x = np.array([[4] + [0] * 63, [5] + [0] * 63, [6] + [0] * 63], dtype=np.int64)
    label, dist = ball_kmeans.assign(x, np.zeros(3, dtype=np.int64), balls)
    assert label.tolist() == [0, 0, 1] and dist.tolist() == [16, 25, 16]


# Phrase collocations


def brute_phrases(rows, longest=4, least=30, covered=80, most=2000):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] < covered * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, collocations.BLOCK])
def test_phrases_match_brute_force(spark, block):
    rng = random.Random(2)
    words = ["New", "york", "city", "hall", "of", "the", "über", "Ärger", "a\x00b", "日本", "x" * 300, "(the"]
    rows = [(i, " ".join(rng.choices(words, weights=[9, 9, 6, 4, 8, 8, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 40))) + rng.choice([".", "\n", "\t;", "", "\r\n"]), rng.choice(["en", "de", None])) for i in range(500)]
    rows += [(900, "new york city hall " * 400, "en"), (901, "One.two,three;four:five!six?seven\x0beight\x0cnine " * 40, "en"), (902, None, "en"), (903, "", None), (904, "  \t. ", None), (905, "tie tie " * 31 + ". toe toe " * 31, "und")]
    rows += [rows[3], (None, None, None)]
    df = spark.createDataFrame([wide(*r) for r in rows], WIDE).repartition(3)
    got = sorted(tuple(r) for r in collocations.phrases(df, block=block).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = brute_phrases([(t, lang) for _, t, lang in rows])
    assert got == want and len(got) > 20
    if block > 7:
        few = collocations.phrases(df, most=3)
        assert collections.Counter(r.lang for r in few.collect()) == {"en": 3, "de": 3, "und": 3}


def test_no_phrases(spark):
    empty = spark.createDataFrame([], WIDE)
    assert collocations.phrases(empty).count() == 0
    assert collocations.phrases(spark.createDataFrame([wide(1, None), wide(2, "one two three")], WIDE)).count() == 0


# Shingle dedup


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(least[root(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def test_components_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(5, "Hello there General Reader"), (6, "hello  there\tgeneral reader"), (6, "hello there general reader"), (None, "hello there general reader"), (7, None), (8, ""), (9, " \n "), (10, "one"), (11, "ONE"), (12, "one two"), (None, None), (None, "alone and null")]
    for g in range(4):  # chains of near copies, each some words from the one before
        text = rng.choices(vocabulary, k=120)
        for _ in range(25):
            text = list(text)
            for _ in range(rng.choice([1, 2, 5])):
                text[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((100 + 100 * g + len(rows), " ".join(text)))
    base = rng.choices(vocabulary, k=200)
    rows += [(2000 + i, " ".join(base[: 100 + i] + [f"own{i}"] + base[101 + i :])) for i in range(90)]
    rows += [(3000, "word " * 200_000 + "end"), (3001, "word " * 200_000 + "end"), (3002, "y" * 100_000)]
    df = spark.createDataFrame([wide(*r) for r in rows], WIDE).repartition(4)
    got = sorted((tuple(r) for r in shingle_dedup.report(df).collect()), key=repr)
    assert got == brute_components(rows)
    assert shingle_dedup.report(df.limit(0)).count() == 0
    kept = shingle_dedup.drop_near_copies(df.filter("doc_id is not null"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for d, _, c, _ in brute_components([r for r in rows if r[0] is not None])})


def test_spanning_links_what_all_pairs_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.integers(0, 300, rng.integers(0, 60))] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(own))
    sig = np.array([near_duplicates.minhash(s) for s in sets])
    for left, right in ((np.arange(60), None), (np.arange(30), np.arange(30, 60))):
        right = left if right is None else right
        own = [near_duplicates.labels_of(60, *find(sets, sig, left, right, 0.8, 1e-6)) for find in (near_duplicates.verified, near_duplicates.spanning)]
        assert (own[0] == own[1]).all()


def test_one_member_links_two_halves_of_a_large_bucket(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, near_duplicates.HASHES).astype(np.uint16)
    place = rng.permutation(near_duplicates.HASHES)
    b, x = a.copy(), a.copy()
    b[place[:58]] = rng.integers(0, 1 << 16, 58)
    x[place[:29]] = b[place[:29]]
    rows = [(7, i, bytearray(a.tobytes()), 700) for i in range(350)] + [(7, 350 + i, bytearray(b.tobytes()), 700) for i in range(349)] + [(7, 699, bytearray(x.tobytes()), 700)]
    members = spark.createDataFrame(rows, "key long, node long, sig binary, n long").repartition(3)
    least = near_duplicates.least_matches(0.8, 1e-6)
    own = np.array([np.frombuffer(bytes(r[2]), dtype=np.uint16) for r in (rows[0], rows[350], rows[699])])
    assert len(near_duplicates.surviving(own, np.array([0, 0, 1]), np.array([1, 2, 2]), least)) == 2  # all but the two halves with one another
    found = common.components(near_duplicates.candidate_edges(members, 0.8, 1e-6))
    assert found.agg(F.countDistinct("root"), F.countDistinct("node")).first() == (1, 700)


def test_links_of_a_large_group_are_whole(spark):
    """Over 512 texts in each band's bucket, two near halves joined by a few texts between them."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(400)]
    half = base[:]
    for i in rng.sample(range(400), 44):
        half[i] = f"h{i}"
    between = [base[i] if i % 2 else half[i] for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"n{i}"] + base[201:])) for i in range(600)] + [(600 + i, " ".join(half[:200] + [f"n{i}"] + half[201:])) for i in range(600)] + [(1200 + i, " ".join(between[:100] + [f"m{i}"] + between[101:])) for i in range(3)]
    got = {r.doc_id: r.component_id for r in shingle_dedup.report(spark.createDataFrame([wide(*r) for r in rows], WIDE).repartition(4)).collect()}
    assert set(got.values()) == {c for _, _, c, _ in brute_components(rows)}
