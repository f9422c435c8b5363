"""N-gram Jaccard join: MinHash bands, Bayesian candidate pruning, exact verification, linked groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread
from .decontaminate import words
from .rows import fitting, keep_rows

#: Words of a shingle, least Jaccard similarity, MinHash values, and values of a band. At similarity 0.8 a pair shares
#: one of 24 bands of 4 with probability 1 - (1 - 0.8^4)^24 = 0.999997.
SHINGLE, SIMILARITY, HASHES, BAND = 5, 0.8, 96, 4
#: MinHash values compared at a time, and the posterior probability below which a candidate is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Words of a long text that are hashed at a time.
LONG = 1 << 15
#: Members of a bucket that one task compares; of a larger one, each member first meets REPRESENTATIVES of them, and those
#: that are left over meet all in blocks of up to BLOCK.
BUCKET, REPRESENTATIVES, BLOCK = 512, 16, 2048
#: Groups are compared in blocks of a SHARE-th of their members, but at least LEAST_BLOCK and at most BLOCK, so that the
#: tasks of a large group are many and of even cost.
LEAST_BLOCK, SHARE = 128, 64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Reading:
    """How a text becomes words, and how many of these make a shingle."""

    words: Callable[[str | None], list[bytes]]
    shingle: int


JOINED = Reading(words, SHINGLE)


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def runs(w: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words, in order; a shorter text is one run, one without words none."""
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) > LONG + size:
        return np.concatenate([runs(w[i : i + LONG + size - 1], size) for i in range(0, len(w) - size + 1, LONG)])
    flat = np.frombuffer(b" ".join(w) + b" ", dtype=np.uint8)
    # Words of 256 bytes or more are replaced by their digests, in every text.
    if np.diff(np.flatnonzero(flat == 32), prepend=-1).max() > 256:
        return runs([x if len(x) < 256 else blake2b(x, digest_size=32).hexdigest().encode() for x in w], size)
    up, down = powers(1 << max(16, len(flat).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((flat + np.uint64(1)) * up[: len(flat)], dtype=np.uint64)])
        ends = np.flatnonzero(flat == 32) + 1
        starts = np.concatenate([[0], ends[:-1]])
        first, last = (starts[: len(w) - size + 1], ends[size - 1 :]) if len(w) >= size else (starts[:1], ends[-1:])
        x = (sums[last] - sums[first]) * down[first] ^ (last - first).astype(np.uint64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def shingles(w: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct ``runs``."""
    return np.unique(runs(w, size))


def minhash(x: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hash function's least value over a set that isn't empty."""
    a, b = multipliers()
    low = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(least, (a[:, None] * low[None, i : i + 4096] + b[:, None]).min(axis=1), out=least)
    return least.astype(np.uint16)


@lru_cache(maxsize=4)
def least_matches(similarity: float, tolerance: float) -> tuple[int, ...]:
    """For each multiple of ``STEP`` values compared, the fewest matches with which a pair stays.

    With a uniform prior, after m matches of h the similarity's posterior is Beta(m + 1, h - m + 1).
    """
    def reaching(m: int, h: int) -> float:
        return sum(comb(h + 1, j) * similarity**j * (1 - similarity) ** (h + 1 - j) for j in range(m + 1))

    return tuple(next(m for m in range(h + 1) if reaching(m, h) >= tolerance) for h in range(STEP, HASHES + 1, STEP))


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs (a[i], b[i]) pass the incremental comparison of their MinHash values."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[a[alive], part] == sig[b[alive], part]).sum(axis=1)
        alive, matches = alive[matches >= m], matches[matches >= m]
    return alive


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each item's component, of ``n`` items linked by pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def connect(sig: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Component labels of a large bucket's surviving pairs: each member meets only those not yet reached."""
    label, rest = np.full(len(sig), -1), np.arange(len(sig))
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        label[root] = root
        while todo and len(rest):
            found = surviving(sig, np.full(len(rest), todo.pop()), rest, least)
            new = rest[found]
            label[new] = root
            todo.extend(new)
            rest = np.delete(rest, found)
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups, from batches sorted by ``key``."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        keys = t[key].to_numpy()
        end = np.searchsorted(keys, keys[-1])
        if end:
            yield t.slice(0, end)
        held = t.slice(end)
    if held is not None:
        yield held


def near_in_buckets(batches: Iterator[pa.RecordBatch], similarity: float, tolerance: float, small: int = 64) -> Iterator[pa.RecordBatch]:
    """Edges (member, least member of its component) of pairs that survive in their bucket."""
    least = least_matches(similarity, tolerance)
    for t in whole_groups(batches, "task"):
        task, node = t["task"].to_numpy(), t["node"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint16).reshape(len(t), HASHES)
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        label = np.arange(len(t))
        few = np.repeat(sizes <= small, sizes)
        a, b = [], []
        for d in range(1, small):
            i = np.flatnonzero((task[d:] == task[:-d]) & few[d:])
            if not len(i):
                break
            i = i[surviving(sig, i, i + d, least)]
            a.append(i), b.append(i + d)
        if a:
            label = labels_of(len(t), np.concatenate(a), np.concatenate(b))
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            label[s : s + n] = s + connect(sig[s : s + n], least)
        i = np.flatnonzero(label != np.arange(len(t)))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[label[i]])], names=["a", "b"])


def candidates(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...], once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the pairs whose MinHash values survive; with ``once``, each pair of one list only once."""
    alike = np.zeros((len(a), len(b)), dtype=np.uint8)
    for c in range(STEP):
        alike += sig[a, c][:, None] == sig[b, c][None, :]
    i, j = np.nonzero(alike >= least[0])
    if once:
        i, j = i[i < j], j[i < j]
    keep = np.concatenate([surviving(sig, a[i[k : k + 100_000]], b[j[k : k + 100_000]], least) + k for k in range(0, len(i), 100_000)] or [np.zeros(0, dtype=np.int64)])
    return i[keep], j[keep]


def reaches(common: np.ndarray, size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets of these sizes is at least ``similarity``."""
    return common * (1 + similarity) >= similarity * (size + other) - 1e-9


def one_by_one(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype=np.int64)


def verified(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``; each pair once if these are the same) with at least that Jaccard similarity."""
    a = left.astype(np.int64)
    b = right.astype(np.int64)
    i, j = candidates(sig, a, b, least_matches(similarity, tolerance), left is right)
    if not len(i):
        return i, j
    size = np.array([len(s) for s in sets])
    common = intersections(sets, a, b)[i, j] if len(i) > 8 * (len(a) + len(b)) else one_by_one(sets, a[i], b[j])
    linked = reaches(common, size[a[i]], size[b[j]], similarity)
    return a[i[linked]], b[j[linked]]


def spanning(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, tolerance: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs of ``verified``, by which the same items are linked through others.

    In each round every item's first candidate that isn't linked to it yet is verified; what ``rounds`` leave is verified at once.
    """
    a = left.astype(np.int64)
    b = right.astype(np.int64)
    i, j = candidates(sig, a, b, least_matches(similarity, tolerance), left is right)
    size = np.array([len(s) for s in sets])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    label = np.arange(len(sets))
    for n in range(rounds + 1):
        apart = label[a[i]] != label[b[j]]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        if n < rounds:
            at = np.unique(j, return_index=True)[1]
            common = one_by_one(sets, a[i[at]], b[j[at]])
        else:
            at = np.arange(len(i))
            common = intersections(sets, a, b)[i, j]
        linked = at[reaches(common, size[a[i[at]]], size[b[j[at]]], similarity)]
        found.append((a[i[linked]], b[j[linked]]))
        label = labels_of(len(sets), np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        i, j = np.delete(i, at), np.delete(j, at)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, dense: int = 48, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``.

    Shingles in over ``dense`` sets are multiplied as 0/1 columns; pairs that share a rarer one are counted one by one.
    """
    used = a if a is b or np.array_equal(a, b) else np.concatenate([a, b])
    flat = np.concatenate([sets[k] for k in used])
    row = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate([[0], (flat[1:] != flat[:-1]).astype(np.int64)]))
    count = np.bincount(column)
    shift = 0 if len(used) == len(a) else len(a)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    often = np.flatnonzero(count > dense)
    place = np.full(len(count), -1, dtype=np.int64)
    place[often] = np.arange(len(often))
    at = place[column]
    for k in range(0, len(often), columns):
        here = (at >= k) & (at < k + columns)
        m = np.zeros((len(used), min(columns, len(often) - k)), dtype=np.float32)
        m[row[here], at[here] - k] = 1
        out += m[: len(a)] @ m[shift:].T
    rare = (at < 0) & (count[column] > 1)
    column, row = column[rare], row[rare]
    for d in range(1, dense):
        i = np.flatnonzero(column[d:] == column[:-d])
        if not len(i):
            break
        x, y = row[i], row[i + d]  # ascending within a column
        if shift:
            cross = (x < shift) & (y >= shift)
            np.add.at(out, (x[cross], y[cross] - shift), 1)
        else:
            np.add.at(out, (x, y), 1)
            np.add.at(out, (y, x), 1)
    if not shift:
        np.fill_diagonal(out, [len(sets[k]) for k in a])
    return out.astype(np.int64)


def verify_groups(batches: Iterator[pa.RecordBatch], similarity: float, tolerance: float, count: bool = True) -> Iterator[pa.RecordBatch]:
    """Per member and task: its root there, linked texts and the documents that these stand for (of the links found, if not all are counted)."""
    find = verified if count else spanning
    for t in whole_groups(batches, "task"):
        task = t["task"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        outs: list[list[np.ndarray]] = [[], [], [], []]
        for s, e in zip(starts, [*starts[1:], len(t)], strict=True):
            part = t.slice(s, e - s)
            node, docs, side = (part[c].to_numpy() for c in ("node", "docs", "side"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"].to_pylist()]
            sig = np.array([minhash(x) for x in sets])
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            if part["cross"][0].as_py() and right is left:
                continue
            a, b = find(sets, sig, left, right, similarity, tolerance)
            label = labels_of(len(node), a, b)
            n = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
            m = np.bincount(a, docs[b], len(node)) + np.bincount(b, docs[a], len(node))
            some = np.flatnonzero(n)
            for out, x in zip(outs, (node[some], node[label[some]], n[some], m[some].astype(np.int64)), strict=True):
                out.append(x)
        if outs[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in outs], names=["node", "root", "texts", "docs"])


def sketches(docs: DataFrame, id_col: str, text_col: str, reading: Reading = JOINED) -> DataFrame:
    """Per row: its id, a hash of its text, a digest of its words, the MinHash values of its shingles (none: null) and their number."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                digest, sig, size = [], [], []
                for text in batch.column("text"):
                    w = reading.words(text.as_py())
                    digest.append(digest_of(w))
                    own = shingles(w, reading.shingle)
                    sig.append(minhash(own).tobytes() if w else None)
                    size.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(size, pa.int64())], names=["id", "text_hash", "digest", "sig", "n_shingles"])

    return spread(source).mapInArrow(run, "id long, text_hash long, digest binary, sig binary, n_shingles long")


def texts_of(own: DataFrame) -> DataFrame:
    """The different texts of ``sketches`` with their ``row`` numbers: ``digest, node, id, h, docs, sig``; a text's first row (least id) stands for it."""
    first = F.min(F.struct(F.coalesce(F.col("id"), F.lit(2**63 - 1)).alias("o"), F.col("row").alias("row"), F.col("id").alias("id"), F.col("text_hash").alias("h")))
    return own.groupBy("digest").agg(first.alias("f"), F.count("*").alias("docs"), F.first("sig").alias("sig")).select("digest", F.col("f.row").alias("node"), F.col("f.id").alias("id"), F.col("f.h").alias("h"), "docs", "sig")


def digest_of(w: list[bytes]) -> bytes:
    return blake2b(b" ".join(w), digest_size=16).digest()


def near_representatives(batches: Iterator[pa.RecordBatch], similarity: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Each member with those of its bucket's representatives that it is linked to (``near``), and a group of these (``kin``, or null).

    Representatives that survive against one another, or are linked through others, are one group. A member is linked to
    one representative of every group in which it survives against any; a representative to all that it survives against.
    """
    least = least_matches(similarity, tolerance)
    for batch in batches:
        keys, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        linked: list[list[int]] = [[] for _ in keys]
        kin: list[int | None] = [None] * len(keys)
        for key in np.unique(keys):
            rows = np.flatnonzero(keys == key)
            reps = batch.column("reps")[int(rows[0])].as_py()
            name, m = np.array([r["node"] for r in reps]), len(reps)
            both = np.concatenate([np.frombuffer(b"".join(r["sig"] for r in reps), dtype=np.uint16).reshape(-1, HASHES), sig[rows]])
            i, j = np.triu_indices(m, 1)
            alive = surviving(both, i, j, least)
            group = labels_of(m, i[alive], j[alive])
            met = np.zeros((len(rows), m), dtype=bool)
            a, b = np.divmod(np.arange(len(rows) * m), m)
            alive = surviving(both, a + m, b, least)
            met[a[alive], b[alive]] = True
            for g in np.unique(group)[::-1]:
                inside = np.flatnonzero(group == g)
                some = np.flatnonzero(met[:, inside].any(axis=1))
                for r, c in zip(rows[some].tolist(), inside[met[some][:, inside].argmax(axis=1)].tolist(), strict=True):
                    linked[r].append(int(name[c]))
                    kin[r] = int(name[g])
            for r in np.flatnonzero(np.isin(node[rows], name)).tolist():
                linked[rows[r]] = name[met[r]].tolist()
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), batch.column("sig"), pa.array(linked, pa.list_(pa.int64())), pa.array(kin, pa.int64())], names=["key", "node", "sig", "near", "kin"])


def candidate_edges(members: DataFrame, similarity: float, tolerance: float) -> DataFrame:
    """``a, b``: links whose components are those of all pairs that survive in a bucket of ``members`` (``key, node, sig, n``).

    Buckets of up to ``BUCKET`` members are one task each. In a larger one every member meets a few representatives, in
    place. Those of the group of representatives with most members are linked with one another by this; all others are
    dealt into blocks, and each block meets all members, block by block, so no surviving pair is left out.
    """
    kernel, out = lambda it: near_in_buckets(it, similarity, tolerance), "a long, b long"
    small = members.filter(F.col("n") <= BUCKET).select(F.col("key").alias("task"), "node", "sig")
    edges = by_task(small).mapInArrow(kernel, out)
    sizes = cut(members.filter(F.col("n") > BUCKET).groupBy("key").agg(F.count("*").alias("m")))
    if sizes.isEmpty():
        return edges
    large = cut(members.filter(F.col("n") > BUCKET).select("key", "node", "sig"))
    chosen = large.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES)).alias("part")).agg(F.min_by(F.struct("node", "sig"), F.xxhash64("node", F.lit(1))).alias("rep"))
    reps = cut(chosen.groupBy(F.col("key").alias("__k")).agg(F.array_sort(F.collect_list("rep")).alias("reps")))
    met = cut(large.join(fitting(reps, 256 * REPRESENTATIVES), F.col("key") == F.col("__k")).select("key", "node", "sig", "reps").mapInArrow(lambda it: near_representatives(it, similarity, tolerance), "key long, node long, sig binary, near array<long>, kin long"))
    edges = edges.unionByName(met.select(F.col("node").alias("a"), F.explode("near").alias("b")).filter("a <> b"))
    kin = met.groupBy(F.col("key").alias("__k"), "kin").agg(F.count("*").alias("n"))
    largest = kin.groupBy("__k").agg(F.max(F.when(F.col("kin").isNotNull(), F.struct("n", "kin"))).alias("main"), F.sum("n").alias("m"))
    others = F.col("m") - F.coalesce("main.n", F.lit(0))
    left = cut(largest.filter(others > 0).select("__k", F.col("main.kin").alias("main"), F.ceil(others / BLOCK).cast("int").alias("lone"), F.ceil(F.col("m") / BLOCK).cast("int").alias("all")))
    if left.isEmpty():
        return edges
    both = met.join(fitting(left, 32), F.col("key") == F.col("__k"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    lone = both.filter("not (kin <=> main) or kin is null").withColumn("j", F.explode(upto(F.col("all")))).select(F.xxhash64("key", block(F.col("lone"), 2), "j").alias("task"), "node", "sig")
    every = both.withColumn("i", F.explode(upto(F.col("lone")))).select(F.xxhash64("key", "i", block(F.col("all"), 3)).alias("task"), "node", "sig")
    return edges.unionByName(by_task(lone.unionByName(every)).mapInArrow(kernel, out))


def blocks(members: DataFrame, key: str, size: str, extra: list[str]) -> DataFrame:
    """``task, side, cross`` and ``extra``: members of each ``key``; a large one is dealt into pairs of blocks."""
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col(size) / SHARE)))
    n = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(mine <= o, 0).otherwise(1).alias("side")))
    dealt = members.withColumn("p", F.explode(pairs))
    return dealt.select(F.xxhash64(key, "p.i", "p.j").alias("task"), F.col("p.side").alias("side"), (F.col("p.i") != F.col("p.j")).alias("cross"), *extra)


def by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """Per document: ``doc_id, class_id, text_id, n_links, n_text_links, kept``.

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of at least ``similarity``; words
    are as in ``decontaminate.words``. ``class_id`` is the least id of all documents linked directly or through others,
    ``text_id`` that of those with the same words, ``n_links`` counts linked documents (copies included),
    ``n_text_links`` linked texts with other words, and ``kept`` marks one document (least id) of each class.

    Copies collapse to one text first. Texts that share a MinHash band meet in its bucket, where candidates are dropped
    as soon as the posterior probability of reaching the threshold falls under ``tolerance``. The survivors' components
    are then compared pair by pair, in blocks if large: pruned by the same rule, the rest verified by exact shingle
    sets. Pairs are counted where they are found and never written; components pass on trees of at most one edge a row.

    Defined cases: null, empty and word-free texts have the same words and no shingle: they form a class without
    links; a text of one to four words is one shingle; null ids sort last, repeated rows are documents of their own;
    an empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    own = cut(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    texts = cut(texts_of(own))
    links = cut(linked_texts(docs, texts, id_col, text_col, similarity, tolerance))

    named = links.join(texts.select("node", "id"), "node").groupBy("root").agg(F.min(F.struct(F.coalesce(F.col("id"), F.lit(2**63 - 1)).alias("o"), F.col("node").alias("node"), F.col("id").alias("id"))).alias("f"))
    found = cut(links.join(named.select("root", F.col("f.id").alias("class_id"), F.col("f.node").alias("class_row")), "root").drop("root"))
    whole = texts.join(fitting(found, 48), "node", "left").select("digest", F.col("node").alias("text_row"), F.col("id").alias("text_id"), F.col("docs").alias("copies"), F.col("sig").isNotNull().alias("has_words"), "class_id", "class_row", "n_texts", "n_docs")
    several = cut(whole.filter("copies > 1 or n_texts is not null"))
    joined = own.select("id", "row", "text_hash", "digest").join(fitting(several, 80), "digest", "left")
    alone = F.col("copies").isNull()
    copies = F.when(F.col("has_words"), F.col("copies") - 1).otherwise(0)
    pick = lambda linked, text, row: F.when(alone, F.col(row)).when(F.col("n_texts").isNotNull(), F.col(linked)).otherwise(F.col(text))
    return joined.select(
        F.col("id").alias(id_col), pick("class_id", "text_id", "id").alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("text_id")).alias("text_id"),
        F.when(alone, 0).otherwise(copies + F.coalesce("n_docs", F.lit(0))).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_text_links"),
        (F.col("row") == pick("class_row", "text_row", "row")).alias("kept"), "text_hash",
    )


def verified_texts(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, similarity: float, tolerance: float, reading: Reading = JOINED, count: bool = True) -> DataFrame:
    """``node, root, texts, docs``, cut: for every text (``digest, node, id, h, docs, sig``) and task that found a link of it, its root there.

    With ``count``, all links are found and counted; without, as many as say which texts are linked through others.
    """
    width = 2 * BAND
    keys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width)))))
    bands = texts.filter("sig is not null").select(keys.alias("key"), "node")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = bands.join(shared, "key").join(texts.select("node", "sig"), "node")
    tree = candidate_edges(members, similarity, tolerance)
    groups = cut(components(cut(tree.distinct())).join(texts.drop("sig"), "node"))

    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    wanted = cut(groups.join(sizes, "root").select("node", "root", "n", "digest", F.col("id").alias("text_id"), "h", "docs"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    same = F.col("id").eqNullSafe(F.col("text_id")) & (F.xxhash64("text") == F.col("h"))
    near = source.join(fitting(wanted, 72), same).select("node", "root", "n", "docs", "digest", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                parsed = [reading.words(x.as_py()) for x in part.column("text")]
                # Ids may be repeated; only the text that the digest names is meant.
                own = [k for k, (w, d) in enumerate(zip(parsed, part.column("digest").to_pylist(), strict=True)) if digest_of(w) == d]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(own, pa.int32())) for c in ("node", "root", "n", "docs")], pa.array([shingles(parsed[k], reading.shingle).tobytes() for k in own], pa.binary())], names=["node", "root", "n", "docs", "shingles"])

    sets = near.mapInArrow(read, "node long, root long, n long, docs long, shingles binary").dropDuplicates(["node"])
    return cut(by_task(blocks(sets, "root", "n", ["node", "docs", "shingles"])).mapInArrow(lambda it: verify_groups(it, similarity, tolerance, count), "node long, root long, texts long, docs long"))


def linked_texts(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, similarity: float, tolerance: float) -> DataFrame:
    """``node, root, n_texts, n_docs`` of every text (``digest, node, id, h, docs, sig``) that a link leads to."""
    counted = verified_texts(docs, texts, id_col, text_col, similarity, tolerance)
    roots = components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return counted.groupBy("node").agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("n_docs")).join(roots, "node").select("node", "root", "n_texts", "n_docs")


def join_report(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).drop("text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one document (least id) of each class of ``jaccard_join``; all columns stay."""
    verdict = jaccard_join(docs, id_col, text_col, similarity, tolerance).select(F.col(id_col).alias("__i"), F.col("text_hash").alias("__h"), "kept")
    return keep_rows(docs, verdict, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
