"""Centroid clustering on integer vectors with Hamerly's bounds.

Components become integers, so that distances, sums and ties are exact. Each vector
keeps, in a saved table, its cluster, an upper bound of the distance to its centroid
and a lower bound of the distance to every other. When centroids move, the upper bound
grows by the drift of the own centroid, the lower one shrinks by the largest drift of
another. A vector whose upper bound stays under its lower bound, or under half the way
from its centroid to the next one, keeps its cluster without a look at any centroid;
otherwise the upper bound is made exact, and only if that does not settle it are all
centroids compared, in integers. Bounds carry a margin for rounding and must differ
strictly, so ties always get the full comparison and go to the smaller number.

Only vectors that change cluster are summed, task by task; k x dim sums reach the
driver, whatever the table's size. A round writes one new table, and the one before
is deleted.

Defined results: vectors of another length, or with null, NaN or infinite components,
or a component of 2^19 or more in size (its squares leave 64 bits), are left out; so is
a null vector. A null id is clustered but never starts a centroid; repeated rows are
vectors of their own, of equal ids the smaller vector starts first. Fewer vectors than
k give fewer centroids; without vectors there are no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import arrow_batches
from .storage import discard, saved

#: The largest component: squared distances of `dim` components stay under 2^63, products under 2^53 take the matrix way.
LIMIT, EXACT_IN_DOUBLE = 1 << 27, 1 << 53
MARGIN = 1e-9


@dataclass(frozen=True)
class Spec:
    k: int = 40
    dim: int = 64
    scale: int = 256
    rounds: int = 5
    prefix: str = "2:"


def prepared(rows: DataFrame, spec: Spec, id_: str, vector: str) -> DataFrame:
    """id, q: little-endian 32-bit components."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(spec.scale)) * x.cast("double")))
    raw = F.col(f"`{vector}`")
    fine = (F.size(raw) == spec.dim) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT / spec.scale))
    src = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_}`").alias("id"), F.transform(v, lambda x: x.cast("int")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy().astype("<i4").tobytes()
            width = 4 * spec.dim
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i * width : (i + 1) * width] for i in range(b.num_rows)], pa.binary())], names=["id", "q"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, q binary")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64."""
    top = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < EXACT_IN_DOUBLE:  # every partial sum is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d = x - c[j]
        out[:, j] = (d * d).sum(1)
    return out


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), distance to it and to the next, by comparing all."""
    d = distances(x, c)
    best = d.argmin(1)
    near = d[np.arange(len(x)), best]
    if len(c) == 1:
        return best, np.sqrt(near.astype(float)), np.full(len(x), np.inf)
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    return best, np.sqrt(near.astype(float)), np.sqrt(d.min(1).astype(float))


class Moved:
    """What a move of the centroids does to bounds."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.c = new
        self.drift = np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + MARGIN)
        first = int(self.drift.argmax()) if len(new) else 0
        rest = np.delete(self.drift, first)
        self.other = np.full(len(new), self.drift[first] if len(new) else 0.0)
        if len(new):
            self.other[first] = rest.max(initial=0.0)
        between = distances(new, new).astype(float)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - MARGIN)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New clusters and bounds, and which vectors were compared with all centroids."""
        upper = (upper + self.drift[cluster]) * (1 + MARGIN)
        lower = np.maximum(lower - self.other[cluster], 0) * (1 - MARGIN)
        bound = np.maximum(lower, self.half[cluster])
        open_ = np.flatnonzero(~(upper < bound))
        d = x[open_] - self.c[cluster[open_]]
        upper[open_] = np.sqrt((d * d).sum(1).astype(float)) * (1 + MARGIN)
        open_ = open_[~(upper[open_] < bound[open_])]
        cluster = cluster.copy()
        if len(open_):
            best, near, next_ = scan(x[open_], self.c)
            cluster[open_], upper[open_], lower[open_] = best, near * (1 + MARGIN), next_ * (1 - MARGIN)
        full = np.zeros(len(x), bool)
        full[open_] = True
        return cluster, upper, lower, full


def starts(vectors: DataFrame, spec: Spec) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    h = F.sha2(F.concat(F.lit(spec.prefix), F.col("id").cast("string")), 256)
    rows = vectors.where("id IS NOT NULL").select(h.alias("h"), "q").orderBy("h", "q").limit(spec.k).collect()  # k rows
    return np.array([np.frombuffer(r.q, "<i4") for r in rows], np.int64).reshape(-1, spec.dim)


def _sums(state: DataFrame, spec: Spec, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the sums and counts of clusters by vectors that moved. state: q, cluster, prev."""
    dim = spec.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            x = np.concatenate([_vectors(b.column(0), dim), np.ones((b.num_rows, 1), np.int64)], 1)
            now, prev = b.column(1).to_numpy(), b.column(2).to_numpy()
            np.add.at(total, now, x)
            np.subtract.at(total, prev[prev >= 0], x[prev >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "v"])

    changed = state.where("cluster <> prev").select("q", "cluster", "prev")
    out = np.zeros(k * (dim + 1), object)
    for r in changed.mapInArrow(run, "at bigint, v bigint").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # k x (dim + 1) rows
        out[r["at"]] = int(r.v)
    out = out.reshape(k, dim + 1)
    return out[:, :dim], out[:, dim]


@dataclass
class Clustering:
    """rows: id, cluster, distance (squared). centroids: k x dim. scanned: vectors compared with all centroids, by round."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def cluster(rows: DataFrame, spec: Spec = Spec(), id_: str = "vec_id", vector: str = "embedding") -> Clustering:
    spark = rows.sparkSession
    arrow_batches(spark)
    base = saved(spark, prepared(rows, spec, id_, vector), "vectors")
    c = starts(base, spec)
    k, dim = len(c), spec.dim
    kind = dict(base.dtypes)["id"]
    schema = f"id {kind}, q binary, cluster int, prev int, upper double, lower double, scanned boolean"
    names = ["id", "q", "cluster", "prev", "upper", "lower", "scanned"]
    if not k:
        return Clustering(base.where("1 = 0").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), c, [])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, near, next_ = scan(_vectors(b.column(1), dim), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(np.full(len(best), -1, np.int32)), pa.array(near * (1 + MARGIN)), pa.array(next_ * (1 - MARGIN)), pa.array(np.ones(len(best), bool))], names=names)

    def again(moved: Moved):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                was = b.column(2).to_numpy()
                now, upper, lower, full = moved.assign(_vectors(b.column(1), dim), was, b.column(4).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(now.astype(np.int32)), pa.array(was), pa.array(upper), pa.array(lower), pa.array(full)], names=names)

        return run

    state = saved(spark, base.mapInArrow(first, schema), "clusters")
    discard(base)
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    scanned = []
    for _ in range(spec.rounds):
        ds, dn = _sums(state, spec, k)
        sums, counts = sums + ds, counts + dn
        old, c = c, np.array([[int(s) // int(n) for s in row] if n else list(keep) for row, n, keep in zip(sums, counts, c.tolist(), strict=True)], np.int64)
        before, state = state, saved(spark, state.mapInArrow(again(Moved(old, c)), schema), "clusters")
        discard(before)
        scanned.append(state.where("scanned").count())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _vectors(b.column(1), dim) - c[b.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((d * d).sum(1))], names=["id", "cluster", "distance"])

    out = state.select("id", "q", "cluster").mapInArrow(measured, f"id {kind}, cluster int, distance bigint")
    return Clustering(out, c, scanned)


def described(found: Clustering, id_: str = "vec_id") -> DataFrame:
    """id, cluster, distance, the inertia of the cluster and of all, a digest of the cluster's centroid."""
    spark = found.rows.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(found.centroids.tolist())]
    per = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = per.agg(F.sum("own").alias("all"))
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(per, "cluster").crossJoin(total)  # k rows and one
    facts = F.broadcast(named.select("cluster", F.col("own").cast("bigint").alias("cluster_inertia"), F.col("all").cast("bigint").alias("inertia"), "centroid_sha256"))
    return found.rows.join(facts, "cluster").select(F.col("id").alias(id_), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
