"""Exact top-k search: norm-bucketed retrieval.

Candidates are grouped by length into buckets and packed into blocks. First blocks of the
longest vectors give each query a score that its k-th best surely reaches. For every
other block that score is a cosine threshold local to the block's bucket: too high for
any vector of that length, and the block never meets the query; high, and the query's largest
coordinates rule vectors out; low, and only the vectors' own lengths do. What is left is
verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.llm.shared import materialize


@dataclass(frozen=True)
class Search:
    """scale: components become floor(scale * x). ratio: of lengths within a bucket. block_rows, query_rows: rows packed together.

    From the cosine threshold `steep` up, the `focus` largest coordinates of a query prune.
    together: blocks that one copy of a block of queries meets. slice_blocks: blocks of a bucket, or
    of queries, that meet others under one key. first_bytes: first blocks are broadcast up to this size over all dimensions.
    """

    k: int = 5
    scale: int = 256
    ratio: float = 1.1
    block_rows: int = 4_096
    query_rows: int = 1_024
    steep: float = 0.5
    focus: int = 3
    together: int = 16
    slice_blocks: int = 256
    first_bytes: int = 64 << 20


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, how: Search) -> DataFrame:
    """(id, dim, bucket, norm2, vec): vectors with finite components only, and an id."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    q = F.transform(x, lambda v: F.floor(F.lit(how.scale) * v.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), q.alias("vec")).withColumn("dim", F.size("vec"))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.withColumn("norm2", norm2)
    return rows.withColumn("bucket", F.when(F.col("norm2") > 0, F.floor(F.log(F.sqrt("norm2")) / F.log(F.lit(how.ratio)))).otherwise(F.lit(-1)).cast("int"))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each block: ids, vectors end to end. A block has about as many rows as it was dealt."""
    item = F.struct("norm2", "id", "vec")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).select(*keys, F.transform("items", lambda i: i["id"]).alias("ids"), F.flatten(F.transform("items", lambda i: i["vec"])).alias("vecs"))


def _matrix(row_ids: list[int], vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(row_ids, np.int64)
    return ids, vecs.reshape(len(ids), -1) if len(ids) else vecs.reshape(0, 0)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum is exact there, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most >= 2**63 and np.abs(q.astype(np.float64) @ p.astype(np.float64).T).max(initial=0) >= 2**63 * (1 - 1e-9):
        raise OverflowError("an inner product does not fit 64 bits")
    return q @ p.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, p_ids: np.ndarray, p: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best in a block whose rows ascend by length; floor: scores that suffice."""
    q_norm, p_norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
    unit = p / np.maximum(p_norm, 1e-300)[:, None]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q_ids)):
        left = np.arange(len(p_ids))
        if floor[i] > 0 and len(left):
            bound = floor[i] * (1 - 1e-9)
            if q_norm[i] * p_norm[-1] < bound:
                continue  # the whole bucket is too short
            left = left[np.searchsorted(p_norm, bound / q_norm[i], "left") :]
            cosine = min(1.0, bound / (q_norm[i] * p_norm[-1]))
            if cosine >= how.steep:
                # The angle to each focus coordinate lies within the threshold's angle of the query's own.
                turn = np.arccos(cosine)
                own = q[i] / q_norm[i]
                for f in np.argsort(-np.abs(own))[: how.focus]:
                    angle = np.arccos(np.clip(own[f], -1, 1))
                    low, high = np.cos(min(np.pi, angle + turn)) - 1e-9, np.cos(max(0.0, angle - turn)) + 1e-9
                    left = left[(unit[left, f] >= low) & (unit[left, f] <= high)]
        left = left[p_ids[left] != q_ids[i]]
        score = _products(q[i : i + 1], p[left])[0]
        enough = score >= floor[i]
        left, score = left[enough], score[enough]
        top = _best(score, p_ids[left], how.k)
        out.append((np.full(len(top), q_ids[i]), p_ids[left][top], score[top]))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, c


def top_k(vectors: DataFrame, every: int, how: Search = Search(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by `every`; returns query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component take no part, as rows without
    an id. Vectors meet those of their own dimension. Rows with the query's own id aren't its
    candidates; a candidate id that rows repeat may come as often. A product beyond 64 bits raises.
    """
    rows = materialize(_quantised(vectors, id_col, vec_col, how), "topk_vectors")
    queries = rows.where(F.col("id") % every == 0)
    groups = max(1, -(-queries.count() // how.query_rows))
    # One narrow row per bucket, of which the range of lengths allows some thousands: a full bucket is dealt over many blocks.
    full = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / how.block_rows).cast("long").alias("blocks"))
    # Rows are dealt by their place in the written table: rows alike don't share a block beyond its size.
    place = lambda seed: F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    dealt = rows.withColumn("_place", place(1)).join(full, ["dim", "bucket"]).withColumn("part", F.pmod("_place", F.col("blocks"))).drop("_place")
    packed = materialize(_packed(dealt, ["dim", "bucket", "part"]), "topk_blocks")
    asked = materialize(_packed(queries.withColumn("grp", F.pmod(place(2), F.lit(groups)).cast("int")), ["dim", "grp"]), "topk_queries").select("dim", "grp", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    # Blocks are narrow rows here: of each dimension those of the longest vectors, with query_rows rows or as few more as whole blocks allow.
    sized = packed.select("dim", "bucket", "part", F.size("ids").alias("rows"))
    by_bucket = sized.groupBy("dim", "bucket").agg(F.sum("rows").alias("rows"))
    longer = F.coalesce(F.sum("rows").over(W.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = by_bucket.withColumn("longer", longer).where(F.col("longer") < how.query_rows).select("dim", "bucket", "longer")
    # Of a bucket the first query_rows parts suffice: no block is empty.
    inside = sized.where(F.col("part") < how.query_rows).join(tops, ["dim", "bucket"])
    ahead = F.col("longer") + F.coalesce(F.sum("rows").over(W.partitionBy("dim", "bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    longest = inside.withColumn("ahead", ahead).where(F.col("ahead") < how.query_rows).select("dim", "bucket", "part", "rows")
    # One row per dimension: its first blocks, and how many slices of blocks each of its buckets has.
    slices = F.ceil(F.col("blocks") / how.slice_blocks).cast("int").alias("slices")
    spans = full.groupBy("dim").agg(F.collect_list(F.struct("bucket", slices)).alias("spans"))
    first = packed.join(longest.drop("rows"), ["dim", "bucket", "part"]).groupBy("dim").agg(F.flatten(F.collect_list("ids")).alias("f_ids"), F.flatten(F.collect_list("vecs")).alias("f_vecs")).join(spans, "dim")
    size = longest.agg(F.sum(F.col("rows") * (F.col("dim") + 1) * 8)).first()[0] or 0
    if size <= how.first_bytes:
        begun = asked.join(F.broadcast(first), "dim")
    else:
        # Many dimensions: each with a copy of its first blocks for every slice of its blocks of queries.
        salted = asked.withColumn("salt", F.floor(F.col("grp") / how.slice_blocks))
        begun = salted.join(first.join(salted.select("dim", "salt").distinct(), "dim"), ["dim", "salt"]).drop("salt")

    kept = ["dim", "grp", "q_ids", "q_vecs", "spans"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].values.to_numpy()  # noqa: B023, E731
                q_ids, q = _matrix(get("q_ids"), get("q_vecs"))
                f_ids, f = _matrix(get("f_ids"), get("f_vecs"))
                score = _products(q, f).astype(np.float64)
                score[q_ids[:, None] == f_ids[None, :]] = -np.inf
                score.sort(axis=1)
                floor = score[:, -how.k] if score.shape[1] >= how.k else np.full(len(q_ids), -np.inf)
                # The length from which on a vector can reach the floor of any of these queries.
                length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                need = float(np.where(floor > 0, floor * (1 - 1e-9) / np.maximum(length, 1e-300), 0.0).min(initial=np.inf))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in kept), pa.array([floor], pa.list_(pa.float64())), pa.array([need])], names=[*kept, "floor", "need"])

    # Few rows, one for query_rows queries.
    schema = "dim int, grp int, q_ids array<long>, q_vecs array<long>, spans array<struct<bucket:int,slices:int>>, floor array<double>, need double"
    started = materialize(begun.mapInArrow(start, schema), "topk_started")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].values.to_numpy()  # noqa: B023, E731
                q_ids, q = _matrix(get("q_ids"), get("q_vecs"))
                p_ids, p = _matrix(get("ids"), get("vecs"))
                found = search_block(q_ids, q, get("floor"), p_ids, p, how)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    # Which blocks a block of queries must meet is told from narrow rows; vectors travel for those pairs only.
    enough = F.filter("spans", lambda s: F.pow(F.lit(how.ratio), s["bucket"] + 1) * (1 + 1e-9) >= F.col("need"))
    told = started.select("dim", "grp", F.explode(enough).alias("_span")).select("dim", "grp", "_span.bucket", F.explode(F.sequence(F.lit(0), F.col("_span.slices") - 1)).alias("slice"))
    pairs = sized.select("dim", "bucket", "part", F.floor(F.col("part") / how.slice_blocks).cast("int").alias("slice")).join(told, ["dim", "bucket", "slice"]).drop("slice")
    copies = pairs.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / how.together).cast("int").alias("copies"))
    dealt = pairs.join(copies, ["dim", "grp"]).withColumn("copy", F.pmod(F.xxhash64("bucket", "part"), F.col("copies")).cast("int")).drop("copies")
    copied = started.drop("need", "spans").join(copies, ["dim", "grp"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = packed.join(dealt, ["dim", "bucket", "part"]).join(copied, ["dim", "grp", "copy"]).mapInArrow(verify, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
