"""Centroid clustering: Lloyd's rounds in exact integers, with clusters as balls that spare most comparisons."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import remove
from .common import shared_folder, spread

#: Clusters, rounds, components of a vector, and the factor of the integer grid.
CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Largest magnitude of an integer component: squared distances of 64 of them fit into 64 bits.
LARGEST = 1 << 27
#: Largest magnitude up to which products of vectors are exact in doubles.
EXACT = 1 << 22
#: Centroids that the driver holds, as numbers: clusters times components.
HELD = 1 << 20


@dataclass(frozen=True)
class Balls:
    """Centroids, and for each its neighbours (nearest first) with the least squared distance at which each must be met.

    A cluster's ball holds its members. A centroid j is a neighbour of i if half the way to it is within i's ball. A member
    nearer to i than half the way to the nearest neighbour is in the stable core; otherwise it lies in an annulus, between
    half the ways to two neighbours, and meets only those up to it.
    """

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    bounds: list[np.ndarray]

    @staticmethod
    def of(centroids: np.ndarray, radii: list[int] | None) -> Balls:
        """``radii``: for each ball an upper bound of the squared distance of its members to the new centroid; -1 without members."""
        k = len(centroids)
        apart = squared(centroids, centroids) if k else np.zeros((0, 0), dtype=np.int64)
        near, bounds = [], []
        for i in range(k):
            order = np.array([j for j in np.lexsort((np.arange(k), apart[i])) if j != i], dtype=np.int64)
            bound = (apart[i][order] + 3) // 4  # 4 * d^2 < D^2 exactly if d^2 < this
            met = np.ones(len(order), dtype=bool) if radii is None else np.array([b <= radii[i] for b in bound.tolist()], dtype=bool)
            near.append(order[met])
            bounds.append(bound[met])
        return Balls(centroids, near, bounds)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if max(np.abs(a).max(), np.abs(b).max()) <= EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def assign(x: np.ndarray, label: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each row of ``x``, from its cluster so far; ties go to the smaller number."""
    best, dist = label.copy(), np.zeros(len(x), dtype=np.int64)
    for i in np.unique(label):
        own = np.flatnonzero(label == i)
        d = squared(x[own], balls.centroids[i : i + 1])[:, 0]
        dist[own] = d
        annulus = np.searchsorted(balls.bounds[i], d, "right")  # how many neighbours each member meets
        for n, j in enumerate(balls.neighbours[i]):
            some = np.flatnonzero(annulus > n)
            if not len(some):
                break
            at = own[some]
            other = squared(x[at], balls.centroids[j : j + 1])[:, 0]
            wins = (other < dist[at]) | (other == dist[at]) & (j < best[at])
            best[at[wins]], dist[at[wins]] = j, other[wins]
    return best, dist


def first_nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, met all; the first one of equals."""
    return squared(x, centroids).argmin(axis=1)


def grid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept (no component null or not finite), and their integers."""
    column = batch.column("vector")
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
    kept = np.flatnonzero(np.isfinite(values).all(axis=1))  # nulls have become NaN
    with np.errstate(over="ignore"):
        whole = np.floor(values[kept] * SCALE)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"components over {LARGEST // SCALE} have squared distances beyond 64 bits")
    return kept, whole.astype(np.int64)


def partial(x: np.ndarray, label: np.ndarray, dist: np.ndarray, k: int) -> bytes:
    """For each cluster: rows, largest squared distance, sums of the high and low halves of squared distances, and of components."""
    out = np.zeros((k, 4 + x.shape[1]), dtype=np.int64)
    for i in np.unique(label):
        own = label == i
        out[i, :4] = own.sum(), dist[own].max(), (dist[own] >> 32).sum(), (dist[own] & 0xFFFFFFFF).sum()
        out[i, 4:] = x[own].sum(axis=0)
    return out.tobytes()


STATE = "vec_id long, v binary, cluster int, distance long, sums binary"


def rows_of(ids: pa.Array, x: np.ndarray, label: np.ndarray, dist: np.ndarray, k: int) -> pa.RecordBatch:
    """Rows of the state; the first one also holds what the batch adds to each cluster."""
    small = x.astype(np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int32)
    width = small.dtype.itemsize * x.shape[1]
    packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(small.tobytes())])
    sums = pa.array([partial(x, label, dist, k) if r == 0 else None for r in range(len(x))], pa.binary())
    return pa.RecordBatch.from_arrays([ids, packed, pa.array(label.astype(np.int32)), pa.array(dist), sums], names=["vec_id", "v", "cluster", "distance", "sums"])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1])
    values = column.to_pylist()
    for bytes_, kind in ((2 * width, np.int16), (4 * width, np.int32)):
        at = np.flatnonzero(sizes == bytes_)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[r] for r in at), dtype=kind).reshape(len(at), width)
    return out


def totals(state: DataFrame, k: int, width: int) -> list[tuple[int, int, int, list[int]]]:
    """For each cluster its rows, largest squared distance, summed squared distance and summed components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, 4 + width), dtype=np.int64)
        for batch in batches:
            for part in batch.column("sums").drop_null().to_pylist():
                one = np.frombuffer(part, dtype=np.int64).reshape(k, 4 + width)
                most = np.maximum(held[:, 1], one[:, 1])
                held += one
                held[:, 1] = most
        some = np.flatnonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.filter("sums is not null").select("sums").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = [[0, -1, 0, 0, *[0] * width] for _ in range(k)]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.max("x").alias("most")).collect():
        out[r["cluster"]][r["at"]] = r["most"] if r["at"] == 1 else int(r["total"])
    return [(own[0], own[1], (own[2] << 32) + own[3], own[4:]) for own in out]


def initial(kept: DataFrame, seed: int, clusters: int, width: int) -> np.ndarray:
    """The vectors with the least SHA-256 of ``<seed>:<id>``, in that order; equal hashes go by their components, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), width)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 3) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of exactly ``width`` components, none null or not finite, are kept; a component x becomes floor(1024 x).
    Centroids start as the ``clusters`` vectors of least hash; each round assigns every vector to the nearest one (ties:
    the smaller number) and replaces centroids by floor(sum / count); empty ones stay; then vectors are assigned once
    more. All sums and distances are whole numbers, so the result is that of comparing everything with everything.

    Every cluster is a ball; from one round to the next its radius is bounded by the old one and the centroid's move,
    and only centroids within twice that are its neighbours. Of a ball's members, those in its stable core meet none, and
    those in an annulus only the neighbours up to it (``Balls``). Only the first pass meets all centroids. Each pass
    writes a row a vector (its integers in 2 bytes each, its cluster) to the shared folder, with its batch's sums on the
    first row of each batch, so that the next centroids are read from that column alone; the folder before is removed.
    Rounds end early only when no centroid has moved, which further ones would not change. Only numbers by cluster and
    component reach the driver, at most ``HELD``.

    Defined cases: null ids are vectors like others, but none is a first centroid before those with ids; repeated ids
    and vectors are rows of their own; with fewer kept vectors than ``clusters`` there are as many clusters as vectors;
    an empty table gives an empty result; components beyond 131,072 raise an error, as their squared distances don't
    fit into 64 bits; further columns are ignored.
    """
    if clusters * width > HELD:
        raise ValueError(f"at most {HELD} numbers of centroids")
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/balls-{uuid.uuid4().hex}"
    source = vectors.filter(F.size(vector_col) == width).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = grid(batch) if len(batch) else ([], None)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v"])

    start = initial(source.mapInArrow(cells, "vec_id long, v array<long>"), seed, clusters, width)
    k = len(start)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = grid(batch) if len(batch) else ([], None)
            if len(rows):
                label = first_nearest(x, start)
                yield rows_of(batch.column("vec_id").take(pa.array(rows)), x, label, ((x - start[label]) ** 2).sum(1), k)

    def written(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    state = written(spread(source).mapInArrow(begin, STATE), 0)
    found = totals(state, k, width)
    centroids = start
    for n in range(1, rounds + 1):
        moved = np.array([[s // own[0] for s in own[3]] if own[0] else old for own, old in zip(found, centroids.tolist(), strict=True)], dtype=np.int64).reshape(k, width)
        if (moved == centroids).all():
            break
        steps = ((moved - centroids) ** 2).sum(axis=1).tolist()
        radii = [(isqrt(own[1]) + 1 + isqrt(step) + 1) ** 2 if own[0] else -1 for own, step in zip(found, steps, strict=True)]
        balls, centroids = Balls.of(moved, radii), moved

        def again(batches: Iterator[pa.RecordBatch], balls: Balls = balls) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = unpacked(batch.column("v"), width)
                    label, dist = assign(x, batch.column("cluster").to_numpy().astype(np.int64), balls)
                    yield rows_of(batch.column("vec_id"), x, label, dist, k)

        state = written(state.select("vec_id", "v", "cluster").mapInArrow(again, STATE), n)
        found = totals(state, k, width)
        remove(spark, f"{folder}/{n - 1}")
    inertia = sum(own[2] for own in found)
    if inertia >= 1 << 63:
        raise ValueError("the summed squared distance is beyond 64 bits")
    by = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1) if k else F.lit(None)
    digests = [sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    own = by([own[2] for own in found]).cast("long")
    return state.select(F.col("vec_id").alias(id_col), "cluster", "distance", own.alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), by(digests).cast("string").alias("centroid_sha256"))


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 3) -> str:
    """The same by comparing every vector with every centroid in each round."""
    near = """SELECT r, x, c, d FROM (SELECT r, x, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
        SELECT v.r, v.x, m.c, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n} m)) WHERE place = 1"""
    move = """SELECT c, x FROM (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
        SELECT c, i, sum(x[i]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{n}, range(1, {end}) t(i) GROUP BY c, i) GROUP BY c)
        UNION ALL SELECT c, x FROM c{n} WHERE c NOT IN (SELECT c FROM a{n})"""
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "v AS MATERIALIZED (SELECT vec_id, x, row_number() OVER () AS r FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {clusters}))",
    ]
    for n in range(rounds):
        parts += [f"a{n} AS MATERIALIZED ({near.format(n=n)})", f"c{n + 1} AS MATERIALIZED ({move.format(n=n, end=width + 1)})"]
    parts.append(f"a AS MATERIALIZED ({near.format(n=rounds)})")
    return f"""WITH {", ".join(parts)}
    SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m.x, ',')) AS centroid_sha256
    FROM a JOIN v ON v.r = a.r JOIN c{rounds} m ON m.c = a.c"""
