"""Toxicity by nearest labelled examples: exact cosine of whole weighted TF-IDF vectors over a block-max inverted index."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, slices, spread
from .language_id import fold

#: Bound of the fit: labelled examples of each class.
PER_CLASS = 4000
#: Every word is a term, of weight BASE times its idf; a term that at least MIN_DF examples have and whose association
#: with the label has a chi-square of at least CHI2 (p = 0.001) weighs more by its log odds ratio, whichever its sign.
BASE, MIN_DF, CHI2 = 0.1, 5, 10.83
#: Neighbours that vote, examples in a block of the index, and the pull of the votes towards the prior.
NEIGHBOURS, BLOCK, PULL = 15, 64, 0.5
#: A term that more than one in DENSE examples have is kept as a row of weights; NEAR softens the vote of a copy.
#: QUERIES texts are compared with the index at once.
DENSE, NEAR, QUERIES = 4, 0.01, 128
#: Lengths of beginnings of words that are terms.
PREFIXES = (4, 5, 6)
#: Shares of a document's words at which a stem counts as a term of its own.
SHARES = (0.005, 0.01, 0.02)
#: Characters of a long text whose words are counted at a time.
LONG = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: What terms that are whole words look like.
WHOLE = "^[^*@]+$"


def stems(word: str) -> list[str]:
    """A word, and the beginnings of a longer one (marked by ``*``), which compounds and inflections share."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def term_counts(text: str | None) -> Counter:
    """Counts of terms: stems, and for each share in ``SHARES`` that a stem has of all words, at twice or more, one mark."""
    words = word_counts(text)
    found: Counter = Counter()
    for word, n in words.items():
        for s in stems(word):
            found[s] += n
    if found:
        total = words.total()
        often = [(s, share) for s, n in found.items() if n > 1 for share in SHARES if n >= share * total]
        found.update({f"{s}@{share}": 1 for s, share in often})
    return found


def word_counts(text: str | None) -> Counter:
    words: Counter = Counter()
    for part in slices(text or "", LONG):
        words.update(_WORD.findall(part.lower()))
    return words


class Index(NamedTuple):
    """Postings by term over examples in blocks; those of frequent terms as rows, with each block's largest weight."""

    terms: dict[str, int]
    idf: np.ndarray  # of each term, times its weight
    unknown: float  # the same for a word that no example has
    starts: np.ndarray  # of a term's postings
    example: np.ndarray
    weight: np.ndarray
    column: np.ndarray  # of a frequent term in dense, else -1
    dense: np.ndarray  # block, place in the block, column
    block_max: np.ndarray  # block, column
    ids: np.ndarray
    toxic: np.ndarray


def build_index(terms: dict[str, int], idf: np.ndarray, examples: list[tuple[int, int, list[tuple[int, int]]]]) -> Index:
    """``examples``: id, label, and (term, count) pairs."""
    row = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
    term, tf = (np.array([p[k] for e in examples for p in e[2]], dtype=np.int64) for k in (0, 1))
    return index_of(terms, idf, 0.0, np.array([e[0] for e in examples]), np.array([e[1] for e in examples]), row, term, tf)


def index_of(terms: dict[str, int], idf: np.ndarray, unknown: float, ids: np.ndarray, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Index:
    """``row, term, tf``: the counts of each example's terms, in order of rows. Similar examples stand together, which sharpens block maxima."""
    w = (1 + np.log(tf)) * idf[term]
    w /= np.sqrt(np.bincount(row, w * w, len(ids)))[row]
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    heavy = np.array([term[a:b][w[a:b] == w[a:b].max()].min() for a, b in zip(first, first[1:], strict=False)])
    order = np.lexsort((ids, toxic, heavy))
    place = np.empty(len(ids), dtype=np.int32)
    place[order] = np.arange(len(ids))
    by_term = np.lexsort((place[row], term))
    example, weight, term = place[row][by_term], w[by_term], term[by_term]
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    often = np.flatnonzero(np.diff(starts) * DENSE > len(ids))
    column = np.full(len(terms), -1, dtype=np.int32)
    column[often] = np.arange(len(often))
    blocks = -(-len(ids) // BLOCK)
    dense = np.zeros((blocks * BLOCK, len(often)))
    own = column[term] >= 0
    dense[example[own], column[term[own]]] = weight[own]
    dense = dense.reshape(blocks, BLOCK, len(often))
    return Index(terms, idf, unknown, starts, example, weight, column, dense, dense.max(axis=1), ids[order], toxic[order])


def nearest(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (terms and weights) the ``k`` examples of largest cosine (ties: first in the index), exactly; ``without`` leaves one out of each.

    Postings of rarer terms are summed whole. The k-th largest of the blocks' maxima bounds the k-th result from below, as
    no weight is negative; frequent terms are added, block by block for all queries at once, where a block's bound (its
    sums so far and the frequent terms' maxima) reaches it.
    """
    n = len(index.block_max) * BLOCK
    sums, often = np.zeros((len(queries), n)), np.zeros((len(queries), index.dense.shape[2]))
    for i, (terms, weights) in enumerate(queries):
        column = index.column[terms]
        rare = column < 0
        often[i, column[~rare]] = weights[~rare]
        start, end = index.starts[terms[rare]], index.starts[terms[rare] + 1]
        if len(start):
            parts = list(zip(start.tolist(), end.tolist(), strict=True))
            share = np.concatenate([index.weight[a:b] for a, b in parts])
            share *= np.repeat(weights[rare], end - start)
            sums[i] = np.bincount(np.concatenate([index.example[a:b] for a, b in parts]), share, n)
    left_out = None if without is None else (np.arange(len(queries)), np.array(without))
    if left_out:
        sums[left_out] = 0
    by_block = sums.reshape(len(queries), -1, BLOCK)

    def reached(high: np.ndarray) -> np.ndarray:
        """The k-th largest of the blocks' maxima: at least ``k`` examples have it."""
        return np.partition(high, -k, axis=1)[:, -k] - 1e-9 if high.shape[1] >= k else np.zeros(len(high))

    high = by_block.max(axis=2)
    least, bound = reached(high), high + often @ index.block_max.T
    for b in range(len(index.block_max)):
        open_ = np.flatnonzero(bound[:, b] >= least)
        if len(open_):
            by_block[open_, b] += often[open_] @ index.dense[b].T
    if left_out:
        sums[left_out] = 0
    out = []
    for own, low in zip(sums, reached(by_block.max(axis=2)), strict=True):
        found = np.flatnonzero(own >= max(low, 1e-300))
        best = found[np.lexsort((found, -np.round(own[found], 12)))[:k]]
        out.append((best, own[best]))
    return out


def vote(index: Index, found: np.ndarray, scores: np.ndarray, share: float, prior: float) -> float:
    """Log-odds of the neighbours' votes, by similarity (a copy outweighs all that are merely alike), with ``PULL`` votes for the prior.

    ``share`` is the toxic share among the examples, ``prior`` that among all labelled documents: votes are weighed
    so that a sample with as many of either class stands for the population.
    """
    w = np.where(index.toxic[found] == 1, prior / share, (1 - prior) / (1 - share)) * scores**2 / (1 + NEAR - np.minimum(scores, 1))
    p = (w[index.toxic[found] == 1].sum() + PULL * prior * prior) / (w.sum() + PULL * prior)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve through left-out votes, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def weights_of(d1: np.ndarray, df: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The size of the log odds ratio of terms that ``d1`` toxic of all ``df`` examples have, 0 where it is not certain."""
    d0 = df - d1
    chi2 = (n1 + n0) * (d1 * (n0 - d0) - d0 * (n1 - d1)) ** 2.0 / np.maximum(float(n1) * n0 * df * (n1 + n0 - df), 1)
    ratio = np.log((d1 + 0.5) * (n0 - d0 + 0.5) / ((d0 + 0.5) * (n1 - d1 + 0.5)))
    return np.where((df >= MIN_DF) & (chi2 >= CHI2), np.abs(ratio), 0.0)


class Model(NamedTuple):
    index: Index | None
    share: float
    prior: float
    slope: float
    offset: float


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from up to ``per_class`` labelled documents of each class, those of least hash.

    ``labels`` has ``doc_id, toxic`` (several labels of a document: toxic if one is). The prior counts all labels.
    Words of the sample are counted in tasks; the bounded sample's words, and those beginnings and marks that are
    associated with the label, reach the driver in Arrow columns.
    """
    label = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = cut(label.filter("y in (0, 1)"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    ids = cut(bounded_sample(known, "y", "doc_id", per_class).select(F.col("doc_id").alias("__id"), "y"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "y", "text").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [term_counts(t.as_py()) for t in part.column("text")]
                row = np.repeat(np.arange(len(found)), [len(c) for c in found])
                columns = [part.column(c).take(pa.array(row)) for c in ("doc_id", "y")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([w for c in found for w in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["doc_id", "y", "term", "tf"])

    terms = cut(sample.mapInArrow(count, T.StructType([sample.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])).groupBy("doc_id", "y", "term").agg(F.max("tf").alias("tf")))
    n = {r["y"]: r["n"] for r in terms.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(None, 0.5, prior, 1.0, 0.0)
    df = terms.filter(~F.col("term").rlike(WHOLE)).groupBy("term").agg(F.sum("y").alias("d1"), F.count("*").alias("df")).filter(F.col("df") >= MIN_DF).withColumn("d0", F.col("df") - F.col("d1"))
    gap = F.col("d1") * (n0 - F.col("d0")) - F.col("d0") * (n1 - F.col("d1"))
    chi2 = F.try_divide((n1 + n0) * F.pow(gap.cast("double"), 2), F.lit(float(n1)) * n0 * F.col("df") * (n1 + n0 - F.col("df")))
    chosen = cut(df.filter(chi2 >= CHI2).select("term"))
    kept = terms.filter(F.col("term").rlike(WHOLE)).unionByName(terms.join(chosen, "term", "left_semi").select(terms.columns))
    rows = kept.groupBy("doc_id", "y").agg(F.collect_list(F.struct("term", "tf")).alias("t")).orderBy("doc_id").toArrow().combine_chunks()
    ids, toxic = (rows.column(c).to_numpy() for c in ("doc_id", "y"))
    lists = rows.column("t").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    words = flat.field("term").dictionary_encode()
    term, tf = words.indices.to_numpy().astype(np.int32), flat.field("tf").to_numpy().astype(np.int32)
    place = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
    ids, toxic = ids.copy(), toxic.copy()
    del rows, lists, flat, words  # the driver holds the sample's counts once
    pa.default_memory_pool().release_unused()
    weight = weights_of(np.bincount(term, toxic[row], len(place)), np.bincount(term, minlength=len(place)), n1, n0)
    weight += np.array([0.0 if "*" in w or "@" in w else BASE for w in place])
    idf = (np.log((1 + n1 + n0) / (1 + np.bincount(term, minlength=len(place)))) + 1) * weight
    index = index_of(place, idf, BASE * (np.log(1 + n1 + n0) + 1), ids, toxic, row, term, tf)
    share = n1 / (n1 + n0)
    at = {int(d): i for i, d in enumerate(index.ids)}
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    x = []
    for k in range(0, len(ids), QUERIES):
        own = [(term[a:b], w / np.linalg.norm(w)) for a, b in zip(first[k : k + QUERIES], first[k + 1 : k + 1 + QUERIES], strict=False) for w in [(1 + np.log(tf[a:b])) * idf[term[a:b]]]]
        x += [vote(index, *found, share, prior) for found in nearest(index, own, NEIGHBOURS, [at[int(d)] for d in ids[k : k + QUERIES]])]
    x, y = np.array(x), toxic.astype(np.int64)
    # Each class weighs as it does among all labels.
    slope, offset = calibrate(x, y, np.where(y == 1, prior / n1, (1 - prior) / n0) * (n1 + n0))
    return Model(index, share, prior, slope, offset)


class Reader:
    """Turns texts into query vectors of an index; keeps the terms of words met before."""

    def __init__(self, index: Index):
        self.size = len(index.idf)
        self.index, self.whole, self.marks = index, {}, {}
        self.begin: dict[str, int] = {}
        more = self.size  # bases of marks that are no terms themselves count from here on
        for term, at in index.terms.items():
            if "@" not in term:
                (self.begin if term.endswith("*") else self.whole)[term.removesuffix("*")] = at
        for term, at in index.terms.items():
            base, _, share = term.partition("@")
            if share:
                kind = self.begin if base.endswith("*") else self.whole
                own = kind.setdefault(base.removesuffix("*"), more)
                more += own == more
                self.marks.setdefault(own, []).append((float(share), at))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.places, self.new = array("q", [0]), array("q"), array("b")

    def learn(self, words: set[str]) -> None:
        for word in words:
            at = self.whole.get(word, -1)
            self.new.append(at < 0 or at >= self.size)
            if at >= 0:
                self.places.append(at)
            n = len(word)
            for k in PREFIXES:
                if n > k and (at := self.begin.get(word[:k], -1)) >= 0:
                    self.places.append(at)
            self.known[word] = len(self.first) - 1
            self.first.append(len(self.places))

    def queries(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, terms and their weights in a unit vector, to whose length words that no example has add theirs."""
        counts = [word_counts(t) for t in texts]
        flat = [w for c in counts for w in c]
        if len(self.known) > 1_000_000:
            self.forget()
        self.learn(set(flat) - self.known.keys())
        word = np.array([self.known[w] for w in flat], dtype=np.int64)
        times = np.array([n for c in counts for n in c.values()], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
        first, places, new = np.array(self.first), np.array(self.places), np.array(self.new, dtype=bool)
        rest = np.bincount(text, np.where(new[word], (1 + np.log(times)) * self.index.unknown, 0) ** 2, len(texts))
        n = first[word + 1] - first[word]
        at = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, inverse = np.unique(np.repeat(text, n) << 32 | places[at], return_inverse=True)
        tf = np.bincount(inverse, np.repeat(times, n), len(key)).astype(np.int64)
        text, term = key >> 32, key & 0xFFFFFFFF
        total = np.bincount(np.repeat(np.arange(len(texts)), [len(c) for c in counts]), times, len(texts))
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        out = []
        marked = np.isin(term, np.fromiter(self.marks, dtype=np.int64, count=len(self.marks))) & (tf > 1)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            extra = [at for k in np.flatnonzero(marked[a:b]) + a for share, at in self.marks[int(term[k])] if tf[k] >= share * total[i]]
            own = term[a:b] < self.size
            terms = np.concatenate([term[a:b][own], np.array(extra, dtype=np.int64)])
            w = (1 + np.log(np.concatenate([tf[a:b][own], np.ones(len(extra), dtype=np.int64)]))) * self.index.idf[terms]
            out.append((terms, w / np.sqrt((w * w).sum() + rest[i]) if len(w) else w))
        return out


def score_texts(model: Model, texts: list[str | None], reader: Reader | None) -> list[tuple[float, list[int]]]:
    """Scores and nearest examples of some texts."""
    if model.index is None:
        return [(model.prior, []) for _ in texts]
    out = []
    for found, scores in nearest(model.index, reader.queries(texts), NEIGHBOURS):
        x = model.slope * vote(model.index, found, scores, model.share, model.prior) + model.offset
        out.append((float(1 / (1 + np.exp(-np.clip(x, -30, 30)))), model.index.ids[found[:3]].tolist()))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted, evidence`` for each row: evidence lists the nearest labelled documents, nearest first.

    Defined cases: a null or empty text, and one without a word that an example has, gets the score of no votes; where
    only one class was learned, all get the prior; repeated rows are scored each; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.index) if model.index else None
        for batch in batches:
            column = batch.column("__text")
            found = [f for at in range(0, len(batch), QUERIES) for f in score_texts(model, column.slice(at, QUERIES).to_pylist(), reader)]
            score = np.array([f[0] for f in found], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=[id_col, "score", "predicted", "evidence"])

    return spread(source).mapInArrow(run, T.StructType([source.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted, evidence``; labels are learned only where crc32(id) mod 5 is not 0."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic"))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
