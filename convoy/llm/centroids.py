"""Centroid clustering with Orchard search: Lloyd's rounds over whole numbers, exact from start to end.

Each centroid lists the others by their distance to it. A vector walks its candidate's list from
the near end; when a listed centroid is closer it jumps to that one's list, and what it has met
it doesn't measure again. It stops where the list goes strictly beyond twice its distance to the
candidate: by the triangle inequality all that follows is farther away. All vectors of a batch
walk at the same time.

A round is one pass over the vectors, which stay where they are; of each task only sums by
centroid travel. The centroids, the one thing that every task holds, have a checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.shared import materialize


@dataclass(frozen=True)
class Clustering:
    """clusters start as the vectors whose `salt:<id>` has the least SHA-256. dim: components that a vector must have. scale: components become floor(scale * x).

    most_mb: centroids with their lists that are larger are refused, as every task holds them. batch: vectors that walk together.
    """

    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1_024
    salt: str = "3"
    most_mb: int = 256
    batch: int = 8_192


class Lists:
    """The centroids, and for each its list of the others: nearest first, of equals the smaller number."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids.astype(np.int64)
        k = len(centroids)
        apart = np.array([squared(self.centroids, np.full(k, i), self.centroids) for i in range(k)]).reshape(k, k)
        order = np.array([np.lexsort((np.arange(k), row)) for row in apart], dtype=np.int64).reshape(k, k)
        # A centroid isn't in its own list, though another may lie upon it.
        self.order = np.array([row[row != i] for i, row in enumerate(order)], dtype=np.int64).reshape(k, max(0, k - 1))
        self.apart = np.take_along_axis(apart, self.order, axis=1)


def squared(x: np.ndarray, which: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to the centroids given for each."""
    d = x - centroids[which]
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the smaller number, and how many distances that took."""
    n, k = len(x), len(lists.centroids)
    own = np.zeros(n, np.int64)
    best = squared(x, own, lists.centroids)
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    at = np.zeros(n, np.int64)
    walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    measured = n
    while len(walking):
        listed, away = lists.order[own[walking], at[walking]], lists.apart[own[walking], at[walking]]
        # 4 * best may not fit, so a quarter of the other side is compared, rounded up.
        near = -(-away // 4) <= best[walking]
        walking, listed = walking[near], listed[near]
        new = ~met[walking, listed]
        rows, to = walking[new], listed[new]
        met[rows, to] = True
        distance = squared(x[rows], to, lists.centroids)
        measured += len(rows)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (to < own[rows]))
        at[walking] += 1
        jump = rows[closer]
        own[jump], best[jump], at[jump] = to[closer], distance[closer], 0
        walking = walking[at[walking] < k - 1]
    return own, best, measured


def _kept(vectors: DataFrame, how: Clustering, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): whole numbers of the vectors that have dim components, none null or non-finite."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where((F.size(x) == how.dim) & finite).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vec"))
    most = np.sqrt(2.0**63 / how.dim) / 2 - 1

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.floor(how.scale * batch.column("vec").flatten().to_numpy())
            if np.abs(q).max(initial=0) >= most:
                raise OverflowError("a squared distance may not fit 64 bits")
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * how.dim), pa.array(q.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vec], names=["id", "vec"])

    return rows.mapInArrow(floored, "id long, vec array<int>")


def _batches(batches: Iterator[pa.RecordBatch], how: Clustering) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, how.batch):
            part = batch.slice(i, how.batch)
            yield part.column("id"), part.column("vec").flatten().to_numpy().astype(np.int64).reshape(-1, how.dim)


def _moved(kept: DataFrame, lists: Lists, how: Clustering) -> np.ndarray:
    """The centroids after a round: exact floors of their vectors' means; an empty one stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(lists.centroids)
        # Python's integers: a task's sums have no bound.
        total, count = np.zeros((k, how.dim), object), np.zeros(k, np.int64)
        for _, x in _batches(batches, how):
            own, _, _ = nearest(x, lists)
            by = np.argsort(own, kind="stable")
            first = np.searchsorted(own[by], np.arange(k))
            here = np.bincount(own, minlength=k)
            there = np.flatnonzero(here)
            total[there] += np.add.reduceat(x[by], first[there], axis=0).astype(object)
            count += here
        for c in np.flatnonzero(count):
            s = pa.array([Decimal(int(v)) for v in total[c]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(how.dim, c, np.int32)), pa.array(np.arange(how.dim, dtype=np.int32)), s, pa.array(np.full(how.dim, count[c]))], names=["c", "at", "s", "n"])

    told = kept.mapInArrow(sums, "c int, at int, s decimal(38,0), n long").groupBy("c", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    moved = lists.centroids.copy()
    # clusters * dim rows, as many as the centroids have components.
    for r in told.collect():
        moved[r["c"], r["at"]] = int(r["s"]) // r["n"]
    return moved


def cluster(vectors: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per vector that has dim components, none null or non-finite.

    After how.rounds rounds of assignment and movement vectors are assigned once more; distance is
    squared, and inertias sum it over the cluster and over all. Ties go to the smaller number, so of
    equal centroids the later is empty and stays. Rows without an id are clustered but never a start;
    rows that repeat an id are vectors of their own. Fewer vectors than clusters make fewer centroids; none,
    no rows. Components whose squared distances may not fit 64 bits raise. Other columns are ignored.
    """
    if how.clusters * (how.dim + 2 * how.clusters) * 8 > how.most_mb << 20:
        raise ValueError(f"{how.clusters} centroids are more than {how.most_mb} MB")
    kept = materialize(_kept(vectors, how, id_col, vec_col), "cluster_vectors")
    digest = F.sha2(F.concat(F.lit(f"{how.salt}:"), F.col("id").cast("string")), 256)
    starts = kept.where("id is not null").select(digest.alias("digest"), "vec").orderBy("digest", "vec").limit(how.clusters).collect()
    spark = vectors.sparkSession
    schema = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], schema)
    lists = Lists(np.array([r["vec"] for r in starts], np.int64))
    for _ in range(how.rounds):
        moved = _moved(kept, lists, how)
        if np.array_equal(moved, lists.centroids):
            break  # and so it would stay
        lists = Lists(moved)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, how):
            own, best, _ = nearest(x, lists)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    assigned = materialize(kept.mapInArrow(assign, "id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    told = [(c, s, total, hashlib.sha256(",".join(map(str, lists.centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    # One row per cluster, whose number is checked above.
    known = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
