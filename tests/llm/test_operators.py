"""Corpus operators against brute force and on defined edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.llm import chat_rotation, common, decontaminate, dedup_exact, language_id, license_scan, near_duplicates, packing, sharding, toxicity, url_filter
from tests.conftest import SF

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, score double, kept boolean, n_words long, lang_pred string, __c0 string, __text string, __i long, __h string, __hash string, __row long, __digest string"
LONG = "the quick brown fox jumps over a lazy dog and runs away " * 40_000


def doc(i, text, lang="en"):
    return (i, text, lang, "s", 1, "x", 7, 0.5, True, 3, "zz", "c", "t", 9, "h", "hh", 4, "d")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        doc(1, "Hello there, General Reader of this text"), doc(2, "hello there, general reader of this text"), doc(2, "hello there, general reader of this text"), doc(None, "hello there, general reader of this text"),
        doc(3, None), doc(4, ""), doc(5, "   \n\t "), doc(6, "12345 !!"), doc(7, LONG), doc(8, LONG + " end"), doc(9, passage), doc(10, passage + " tail"), doc(11, "ÄÖÜ äöü ß", None), doc(12, "Released under the MIT License.", None),
        (None,) * 18, (None,) * 18, doc(13, "one two"), doc(14, "One  TWO!"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


# Packing


def test_token_ids_are_those_of_the_tokenizer(table):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    enc = packing.encoder(VOCABULARY)
    texts = [r.text for r in table("documents").select("text").collect()] + ["a  b", "  a", "a\n\n b", " \n", "it's  we'll\t\tgo 12  34 !!    x", "", "日本　　語", "\x1c\x1d a", "x  y z\x85\x85q", "é́ 👩‍👩‍👧  👍🏽"]
    for text in texts:
        assert packing.encode(text, enc) == own.encode(text, add_special_tokens=False).ids
    long = "".join(random.Random(1).choices(["ab", " ", "  ", "\n", "x1"], k=5000))
    assert [i for part in common.slices(long, 100) for i in packing.encode(part, enc)] == own.encode(long, add_special_tokens=False).ids


def test_literals_of_added_tokens_are_these_tokens():
    from tokenizers import Tokenizer

    own, enc = Tokenizer.from_file(VOCABULARY), packing.encoder(VOCABULARY)
    assert packing.encode("a <|endoftext|> b", enc) == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "a  <|endoftext|>  b", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| > <|endoftext", "it<|endoftext|>'s \n"):
        assert packing.encode(text, enc) == own.encode(text, add_special_tokens=False).ids


def test_best_two_fit_packs_everything_tightly():
    rng = random.Random(5)
    for capacity in (16, 100, 1024):
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(5000))
        bins = packing.best_two_fit(counts, capacity)
        used = collections.Counter()
        for times, lengths in bins:
            assert sum(lengths) <= capacity
            for n in lengths:
                used[n] += times
        assert used == counts
        assert sum(t for t, _ in bins) <= 1.02 * sum(n * c for n, c in counts.items()) / capacity + 2


def test_two_pieces_replace_the_smallest():
    # 6 fills to 9 with 3; in place of the 3, 2 + 2 fill the gap of 4 exactly.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, (6, 2, 2))


def check_packing(packed, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        start = 0
        for piece, n in enumerate(packing.lengths_of(len(ids), 1024)):
            want[(r.doc_id, piece, start, n, zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes()))] += 1
            start += n
    rows = packed.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    return len(places), sum(r.length for r in rows)


def test_packing_places_every_piece(spark, docs, empty, table):
    check_packing(packing.pack(docs, VOCABULARY), docs)
    n, total = check_packing(packing.pack(table("documents"), VOCABULARY), table("documents"))
    assert n <= 1.05 * total / 1024 + 1
    assert packing.pack(empty, VOCABULARY).count() == 0
    packed = packing.pack(docs.filter("doc_id < 7"), VOCABULARY, with_ids=True)
    sizes = packing.sequences(packed).select(F.size("input_ids").alias("n")).collect()
    assert sum(r.n for r in sizes) == packed.agg(F.sum("length")).first()[0]


# Exact dedup


def test_exact_dedup(docs, empty):
    rows = dedup_exact.exact_dedup(docs, tracked=4).collect()
    groups = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        groups[hashlib.sha256((r.text or "").translate(lower).encode()).hexdigest()].append(r.doc_id)
    assert len(rows) == docs.count()
    for digest, ids in groups.items():
        own = [r for r in rows if r.text_sha256 == digest]
        assert [r.group_size for r in own] == [len(ids)] * len(ids)
        assert {r.keep_id for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert sum(r.kept for r in own) == 1
    assert dedup_exact.exact_dedup(empty).count() == 0
    kept = dedup_exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert dedup_exact.drop_exact_copies(empty).count() == 0


def test_a_heavy_digest_is_settled_by_broadcast(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = dedup_exact.exact_dedup(many, tracked=16).filter("kept = false or doc_id = 4998").collect()
    assert {r.keep_id for r in rows} == {4998} and {r.group_size for r in rows} == {1667}


# Near duplicates


def brute_links(rows, similarity=0.8):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := decontaminate.words(t)) else frozenset() for _, t in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= similarity - 1e-12] for i, a in enumerate(sets)]
    return links


def test_jaccard_join_matches_brute_force(docs, empty, table):
    for data in (docs, table("documents").limit(200)):
        rows = [(r.doc_id, r.text) for r in data.select("doc_id", "text").collect()]
        links = brute_links(rows)
        out = near_duplicates.join_report(data).collect()
        assert collections.Counter((r.doc_id, r.n_links) for r in out) == collections.Counter((i, len(x)) for (i, _), x in zip(rows, links, strict=True))
        parents = list(range(len(rows)))

        def root(x):
            while parents[x] != x:
                x = parents[x]
            return x

        first = {}
        for i, (_, text) in enumerate(rows):
            parents[root(i)] = root(first.setdefault(tuple(decontaminate.words(text)), i))
            for j in links[i]:
                parents[root(i)] = root(j)
        least = collections.defaultdict(list)
        for i, (d, _) in enumerate(rows):
            least[root(i)].append(d)
        want = collections.Counter((d, min((x for x in own if x is not None), default=None)) for own in least.values() for d in own)
        assert collections.Counter((r.doc_id, r.class_id) for r in out) == want
        assert sum(r.kept for r in out) == len(least)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert near_duplicates.join_report(empty).count() == 0 and near_duplicates.drop_near_duplicates(empty).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "BUCKET", 8)
    monkeypatch.setattr(near_duplicates, "LEAST_BLOCK", 4)
    monkeypatch.setattr(near_duplicates, "REPRESENTATIVES", 2)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    out = {r.doc_id: r.n_links for r in near_duplicates.join_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: len(x) for i, x in enumerate(brute_links(rows))}


def test_pairs_just_over_the_threshold_are_found(spark):
    rng = random.Random(4)
    rows, near = [], 0
    for i in range(300):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = list(a)
        at, n = rng.randrange(150), rng.randrange(10, 24)
        b[at : at + n] = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(196)} for w in (a, b))
        rows[-1] += (0.8 <= len(x & y) / len(x | y) <= 0.85,)
        near += rows[-1][2]
    out = {r.doc_id: r.n_links for r in near_duplicates.join_report(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert near > 50 and sum(out[r[0]] for r in rows if len(r) == 3 and r[2]) >= 0.99 * near


def test_null_ids_meet_only_their_own_texts(spark):
    rows = [(None, " ".join(f"w{i // 2}x{k}" for k in range(40)) + " tail" * (i % 2)) for i in range(2000)]
    out = near_duplicates.join_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("n_links = 1").count() == 2000 and out.filter("kept").count() == 1000


def test_long_words_are_alike_in_texts_of_any_length():
    w = [b"a" * 300, *(b"w%d" % i for i in range(50))]
    assert set(near_duplicates.runs(w).tolist()) <= set(near_duplicates.runs([*w, *(b"y" * 400 for _ in range(10_000))]).tolist())


def test_bayesian_bounds():
    least = near_duplicates.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * near_duplicates.HASHES
    rng = np.random.default_rng(1)
    for matches, h in zip(least, range(16, 97, 16), strict=True):
        assert (rng.binomial(h, 0.8, 200_000) < matches).mean() < 1e-3


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


# Decontamination


def test_contamination_edge_cases(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40))), (2, "two"), (3, None), (None, "hello"), (4, ""), (10, "One TWO")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[(9, 60)].n_hit == 20 and rows[(9, 60)].n_items == 1 and rows[(10, 61)].contaminated
    assert rows[(14, 2)].n_hit == 2 and rows[(14, 2)].items_sha256 == hashlib.sha256(b"10,2").hexdigest()
    assert rows[(3, 0)].n_hit == 0 and not rows[(3, 0)].contaminated
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count()
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    found = decontaminate.hits(docs, bench, with_spans=True, carry=["doc_id", "text"]).filter("doc_id = 9").first()
    assert found.text[found.hit_spans[0]["first"] : found.hit_spans[0]["last"]] == " ".join(f"word{i}" for i in range(20, 40))


def test_blocks_of_a_large_benchmark_give_the_same(spark, table, monkeypatch):
    whole = sorted(map(tuple, decontaminate.contamination(table("documents"), table("benchmark")).collect()))
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 2000)
    assert sorted(map(tuple, decontaminate.contamination(table("documents"), table("benchmark")).collect())) == whole


# Language ID


def test_languages_of_held_out_documents(table, docs, empty):
    data = table("documents")
    rows = language_id.identify(data).join(data.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    edge = {r.doc_id: r for r in language_id.identify(docs.filter("doc_id is not null")).collect()}
    assert {edge[i].lang_pred for i in (3, 4, 5, 6)} == {"und"} and edge[7].lang_pred == "en"
    assert edge[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert language_id.identify(empty).count() == 0
    kept = language_id.drop_unknown(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 7, 8, 9, 13}


def test_texts_of_no_learned_script_are_dropped_and_short_ones_are_kept(spark):
    rng = random.Random(3)
    tongue = {k: ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(60)] for k, letters in {"a": "aeioulnt", "b": "bcdfuiöq", "c": "rstvewxz", "d": "ghjkmpoy"}.items()}
    rows = [(i, " ".join(rng.choices(tongue[k], k=80)), k) for i in range(400) for k in ["abcd"[i % 4]]]
    short = [(1000 + i, " ".join(rng.choices(tongue[k], k=6)), None) for i in range(60) for k in ["abcd"[i % 4]]]
    foreign = []
    for i in range(60):
        letters = rng.sample([chr(c) for c in range(0x430, 0x450)], 12)
        own = ["".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(60)]
        foreign.append((2000 + i, " ".join(rng.choices(own, k=200)), None))
    kept = {r.doc_id for r in language_id.drop_unknown(spark.createDataFrame(rows + short + foreign, "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in rows + short}
    assert language_id.noise_bound(4) * 32 > 4.5 and language_id.noise_bound(1000) > language_id.noise_bound(4)


def test_long_texts_have_the_profile_of_their_words(monkeypatch):
    text = "Grüße aus dem Tal, über alle Berge hinweg. " * 50
    whole = language_id.Profiles(256).bundles([text, "x"])
    monkeypatch.setattr(language_id, "_CHARS", 37)
    assert np.allclose(language_id.Profiles(256).bundles([text, "x"]), whole)


def test_trigrams_are_bound_and_bundled():
    p = language_id.Profiles(512)
    got = p.bundles(["ab", "ab ab", "1 2"])
    v = {c: np.random.default_rng(ord(c)).choice(np.array([-1, 1], dtype=np.float32), 512) for c in "ab "}
    bind = lambda x: np.roll(v[x[0]], 2) * np.roll(v[x[1]], 1) * v[x[2]]
    assert np.allclose(got[0], bind(" ab") + bind("ab ")) and np.allclose(got[1], 2 * got[0]) and not got[2].any()


# Toxicity


def test_nearest_is_exact_cosine():
    rng = np.random.default_rng(2)
    terms = {f"t{i}": i for i in range(50)}
    idf = rng.uniform(1, 5, 50)
    examples = [(i, int(rng.integers(2)), sorted((int(t), int(rng.integers(1, 5))) for t in rng.choice(50, rng.integers(1, 8), replace=False))) for i in range(700)]
    index = toxicity.build_index(terms, idf, examples)
    dense = np.zeros((700, 50))
    for row, i in enumerate(index.ids):
        for t, n in examples[i][2]:
            dense[row, t] = (1 + np.log(n)) * idf[t]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    queries = []
    for _ in range(50):
        t = np.sort(rng.choice(50, 4, replace=False))
        w = (1 + np.log(rng.integers(1, 4, 4))) * idf[t]
        queries.append((t, w / np.linalg.norm(w)))
    for (t, w), (found, scores) in zip(queries, toxicity.nearest(index, queries, 15), strict=True):
        want = dense[:, t] @ w
        assert np.allclose(scores, np.sort(want)[::-1][: len(scores)]) and np.allclose(want[found], scores)


def test_scores_are_those_of_brute_force_cosine_over_all_terms(spark, table):
    data, marks = table("documents"), table("labels").select("doc_id", "toxic")
    model = toxicity.fit(data, marks, per_class=60)
    texts = {r.doc_id: r.text for r in data.collect()}
    index, truth = model.index, {r.doc_id: r.toxic for r in marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}

    def vector(text):
        own, rest = {}, 0.0
        for t, n in toxicity.term_counts(text).items():
            if t in index.terms:
                own[t] = (1 + np.log(n)) * index.idf[index.terms[t]]
            elif "*" not in t and "@" not in t:
                rest += ((1 + np.log(n)) * index.unknown) ** 2
        size = np.sqrt(sum(v * v for v in own.values()) + rest)
        return {t: v / size for t, v in own.items()}

    examples = [(int(i), vector(texts[int(i)])) for i in index.ids]
    assert [truth[i] for i, _ in examples] == index.toxic.tolist()
    for r in toxicity.predict(data, model).collect():
        q = vector(texts[r.doc_id])
        cosine = np.array([sum(v * e.get(t, 0) for t, v in q.items()) for _, e in examples])
        best = np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12)))[: toxicity.NEIGHBOURS]
        best = best[cosine[best] > 0]
        assert len(r.evidence) == min(3, len(best)) and np.allclose([cosine[index.ids.tolist().index(e)] for e in r.evidence], cosine[best[:3]])
        x = model.slope * toxicity.vote(index, best, cosine[best], model.share, model.prior) + model.offset
        assert abs(r.score - 1 / (1 + np.exp(-x))) < 1e-6
        assert r.evidence or not q


def test_toxicity_of_held_out_documents(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        if toxic:
            for k in range(3):
                words[rng.randrange(40)] = rng.choice(["vileness", "vilest", "grubby", "rotten"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    data, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(data, marks).join(marks, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = dict(labels)
    assert all(truth[e] == 1 for r in held if r.predicted for e in r.evidence[:1])
    assert toxicity.toxicity(docs, marks).count() == docs.count()
    assert toxicity.toxicity(empty, marks).count() == 0
    one = toxicity.toxicity(data, marks.filter("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score < 0.5


def test_an_exact_copy_and_a_rare_word_reach_the_score(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30)), int(i < 1500)) for i in range(3000)]
    rows = [(i, t + (" grubby" if i < 12 else " vilest" if i < 900 and y else ""), y) for i, t, y in rows]
    data, marks = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(data, marks)
    copies = [r for r in rows if r[0] % 50 == 40]
    asked = spark.createDataFrame([*[(i, t) for i, t, _ in copies], (-1, "some fresh prose grubby here")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.predict(asked, model).collect()}
    assert all(out[i].evidence[0] == i for i, _, y in copies) and sum(out[i].predicted == y for i, _, y in copies) >= 0.97 * len(copies)
    assert out[-1].predicted == 1 and set(out[-1].evidence) <= set(range(12))


# Sharding


def test_shards_are_even_and_keep_copies_together(spark, docs, empty):
    rng = random.Random(8)
    rows = [(i, f"copy {rng.randrange(60)}" if i % 2 else f"own {i}") for i in range(2000)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert len(out) == 2000 and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    text, where = dict(rows), collections.defaultdict(list)
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
        where[text[r.doc_id]].append(r.shard)
    together = sum(len(set(s)) == 1 for t, s in where.items() if len(s) > 1)
    assert together >= 0.9 * sum(len(s) > 1 for s in where.values())
    edge = sharding.balanced_shards(docs, shards=4).collect()
    sizes = collections.Counter(r.shard for r in edge)
    assert len(edge) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.balanced_shards(empty).count() == 0


def test_a_group_beyond_a_shard_is_split_evenly(spark):
    rows = [(i, "hot" if i % 3 else f"own {i}") for i in range(900)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert set(sizes.values()) == {90}
    hot = collections.Counter(r.shard for r in out if r.doc_id % 3)
    assert sum(n for _, n in hot.most_common(7)) >= 0.95 * 600


def test_ranks_are_gapless(spark):
    df = common.cut(spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, None).otherwise(F.col("id") % 3).alias("k")))
    rows = common.ranked(df, ["k"], [F.col("id")], F.col("id")).collect()
    for k in (None, 0, 1, 2):
        own = sorted(r["__rank"] for r in rows if r.k == k)
        assert own == list(range(len(own)))


# Chats


def brute_rotation(rows, piece_chars=1 << 20):
    """Rows (conv_id, turn, role, text) by plain loops."""
    out = {}
    clean = lambda s: s.replace("<|", "< |")
    for conv in {r[0] for r in rows}:
        own = sorted((2**63 - 1 if t is None else t, clean("unknown" if r is None else r), clean(x or "")) for c, t, r, x in rows if c == conv)
        for me in {r for _, r, _ in own} - {"system"}:
            at = 0
            for _, r, x in own:
                head = "<|im_start|>" + ("system" if r == "system" else "assistant" if r == me else f"user name={r}") + "\n"
                piece = out.setdefault((conv, at // piece_chars, me), [at, 0, "", []])
                piece[1] += 1
                piece[2] += f"{head}{x}<|im_end|>\n"
                if r == me:
                    piece[3].append(f"{at + len(head)}-{at + len(head) + len(x) + 10}")
                at += len(head) + len(x) + 11
    return {k: (v[0], v[1], v[2], ",".join(v[3]), len(v[3])) for k, v in out.items()}


def rotated(df, **options):
    rows = chat_rotation.rotate(df, **options).collect()
    found = {(r.conv_id, r.piece, r.perspective): (r.start, r.n_messages, r.rendered, r.mask, r.n_trained) for r in rows}
    assert len(found) == len(rows)
    return found


def test_rotation_renders_whole_dialogues_for_every_participant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|> all"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "Bye"), (None, 0, None, "alone"), (2, 100, "cat", "late"), (3, 0, "system", "only")]
    rows += [(9, t, "cat" if t == 70 else "ann" if t % 2 else "bob", f"message {t}") for t in range(200)] + [(8, 0, "ann", LONG), (8, 1, "", "")]
    data = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "conv_id long, turn long, role string, text string, m string, piece int, __c string")
    want = brute_rotation(rows)
    assert rotated(data) == want and rotated(data, whole_messages=3) == want
    ann = want[(1, 0, "ann")]
    assert ann[1] == 5 and ann[4] == 2 and all(ann[2][int(a) : int(b)].endswith("<|im_end|>") for a, b in (m.split("-") for m in ann[3].split(",")))
    assert [want[(9, 0, p)][1] for p in ("ann", "bob", "cat")] == [200] * 3
    assert chat_rotation.rotate(data.limit(0)).count() == 0


def test_long_dialogues_go_on_in_pieces_with_offsets_of_the_whole(spark):
    rows = [(c, t, "dan" if t is not None and t < 3 else f"u{i % 2}", f"{i:04d}") for c in (1, None) for i, t in enumerate([*range(3), *[None] * 117])]
    rows += [(2, 0, "eve", "hi")] + [(4, 0, "u", "same")] * 300
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rotated(data, piece_chars=500, whole_messages=10)
    assert got == brute_rotation(rows, 500)
    texts = "".join(got[k][2] for k in sorted(k for k in got if k[0] == 1 and k[2] == "dan"))
    assert texts == rotated(data)[(1, 0, "dan")][2]


# Licenses


def test_licenses_match_brute_force(spark, docs, empty, table):
    texts = list(license_scan.TEMPLATES.values())
    rng = random.Random(6)
    rows = []
    for i in range(60):
        filler = lambda: " ".join(f"f{rng.randrange(999)}" for _ in range(rng.randrange(90)))
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, f"{filler()} {' '.join(w)} {filler()}"))
    got = {r.doc_id: {m["license"] for m in r.matches} for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = decontaminate.words(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        want = set()
        for name, template in license_scan.TEMPLATES.items():
            t = decontaminate.words(template)
            own = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
            block = 1 << max(0, len(own) - 1).bit_length()
            if any(len(own & set(grams[k : k + 2 * block])) >= 0.8 * len(own) - 1e-9 for k in range(0, len(grams), block)):
                want.add(name)
        assert got[i] == want
    found = {r.doc_id: r for r in license_scan.report(docs).collect()}
    assert found[12].licenses == "MIT" and found[3].n_licenses == 0
    match = license_scan.scan_licenses(docs).filter("doc_id = 12").first().matches[0]
    assert (match["start"], match["end"]) == (0, 30) and match["containment"] == 1.0
    assert license_scan.report(empty).count() == 0 and license_scan.scan_licenses(docs, {}).filter(F.size("matches") > 0).count() == 0


def test_a_table_of_many_long_templates(spark):
    rng = random.Random(7)
    texts = {f"L{i}": " ".join(f"t{rng.randrange(4000)}" for _ in range(rng.randrange(20, 700))) for i in range(300)}
    table = spark.createDataFrame([*texts.items(), ("none", None), (None, "a b c d e f")], "license string, text string")
    rows = [(i, f"start {texts[f'L{i}']} end " + " ".join(f"z{k}" for k in range(i))) for i in range(300)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert {r.doc_id: [m["license"] for m in r.matches] for r in got} == {i: [f"L{i}"] for i in range(300)}
    assert all(r.matches[0]["start"] == 6 and r.matches[0]["end"] == 6 + len(texts[f"L{r.doc_id}"]) for r in got)


def test_bands_catch_templates_at_the_threshold():
    for block in (1, 2, 4, 8, 32, 64):
        n = block // 2 + 1
        j = 0.8 * n / (2 * block + 0.2 * n)
        assert (1 - j) ** license_scan.bands_for(block, 0.8, 1e-6) <= 1e-6


# URLs


def test_urls(spark):
    urls = [
        "https://A.Example.ORG/es/x?q", "http://example.org/en/12#t", "example.org/none", None, "ftp://sub.site.com/fr/", "http://site.com/de/1", "http://good.net", "https://bad.net/p?x=://y.org/", "://", "http://xexample.org/en/1",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, "http://good.net/", "h", "v")], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(6, 0)] * 1 + [(7, 1), (7, 0), (None, 1)], "page_id long, bad int")
    rows = url_filter.judge_urls(pages, outcomes).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 11
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (by[1].rule, by[1].verdict) == ("example.org/en/1", "block") and (by[9].rule, by[9].verdict) == ("org/", "allow")
    assert (by[2].host, by[2].path, by[2].rule) == ("", "", None) and by[3].host == "" and by[8].host == ""
    assert (by[4].rule, by[4].verdict, by[5].rule, by[5].verdict) == ("com/fr/", "allow", "com/de/", "block")
    assert by[7].path == "/p" and by[7].n_bad == 1 and by[6].path == ""
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge_urls(pages, outcomes.limit(0)).filter("rule is null and verdict = 'block'").count() == 0
    long = "http://long.net/" + "p" * 300_000
    assert url_filter.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), outcomes).first().path == long[15:]


def test_registered_domains_follow_a_table_of_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "x.y.z.city.kobe.jp", "n.net", "", "b.kobe.jp")], "host string")
    suffixes = spark.createDataFrame([("co.uk",), ("CITY.kobe.jp",), ("kobe.jp",), (None,)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in url_filter.registered(hosts, suffixes).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.z.city.kobe.jp": ("city.kobe.jp", "z.city.kobe.jp"), "n.net": ("net", "n.net"), "": ("", ""), "b.kobe.jp": ("kobe.jp", "b.kobe.jp")}


def test_a_bad_host_is_blocked_and_its_neighbour_is_not(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.shop.net/{i}") for i in range(400)]
    marks = [(i, int(i % 2 and i % 20 != 1)) for i in range(300)]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")).collect()
    assert {(r.host, r.verdict) for r in out} == {("bad.shop.net", "block"), ("good.shop.net", "allow")}
