"""Hard-negative mining with bounds along a spanning tree of anchors.

Rows are packed into blocks by label, anchors likewise, and each block of anchors gets a least
spanning tree. Where a block of anchors meets a block of candidates only the root's scores are
all computed. A child's score of a candidate differs from its parent's by at most the edge times
the candidate's norm, so it lies in a range; only candidates whose range overlaps a window
that the child asks for are scored again, and the ranges of the others are handed down.

Anchors first find their positives among blocks of their label. The positives' scores are the
windows, and all blocks that can reach one are searched for negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.llm.shared import materialize


@dataclass(frozen=True)
class Mining:
    """Anchors are the rows whose id is divisible by `every`. Negatives score between low and high hundredths of their positive.

    scale: components become floor(scale * x). block_rows, anchor_rows: rows packed together. chunk: blocks
    listed together when anchors are told which to meet. small: MB up to which a table of labels is broadcast.
    """

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    block_rows: int = 4_096
    anchor_rows: int = 512
    chunk: int = 256
    small: int = 64


_BLOCK = ["dim", "large", "grp"]
#: Of a product's or a bound's size, for what floating point loses.
_SLACK = 1e-9


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, how: Mining) -> DataFrame:
    """(id, label, dim, norm, vec): rows with an id, a label and a vector of finite components only."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & finite)
    q = F.transform(x, lambda v: F.floor(F.lit(how.scale) * v.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("vec")).withColumn("dim", F.size("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    # A number for each row, fixed once the rows are written, deals them: rows alike in all spread as others do.
    return rows.withColumn("norm", norm).withColumn("ord", F.monotonically_increasing_id())


def _dealt(rows: DataFrame, how: Mining) -> DataFrame:
    """rows with large and grp: a label with a block's rows has groups of its own, others share groups by hash. Then parts, aparts: blocks of each group."""
    n = rows.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= how.block_rows
    few = n.where(~large).groupBy("dim").agg(F.ceil(F.sum("n") / how.block_rows).cast("long").alias("bins"))
    # One row per dimension, of which there are few.
    named = n.join(F.broadcast(few), "dim", "left").select("dim", "label", large.alias("large"), F.when(large, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.col("bins"))).alias("grp"))
    named = materialize(named, "mining_labels")
    small = 48 * named.count() <= how.small << 20
    return rows.join(F.broadcast(named) if small else named, ["dim", "label"])


def _parts(rows: DataFrame, each: int, count: str) -> DataFrame:
    """(dim, large, grp, count): blocks of each group."""
    return rows.groupBy(*_BLOCK).agg(F.ceil(F.count(F.lit(1)) / each).cast("long").alias(count))


def _field(items: str, name: str) -> Column:
    return F.transform(items, lambda i: i[name])


def _packed(rows: DataFrame, part: str, parts: str, prefix: str) -> DataFrame:
    """One row for each block: ids, labels, vectors end to end, and the largest norm. A block has about as many rows as it was dealt."""
    of = F.pmod(F.xxhash64("ord"), F.col(parts)).cast("long")
    items = F.array_sort(F.collect_list(F.struct("id", "label", "vec")))
    packed = rows.withColumn(part, of).groupBy(*_BLOCK, part).agg(items.alias("items"), F.max("norm").alias("longest"))
    each = [_field("items", c).alias(f"{prefix}{c}s") for c in ("id", "label")]
    return packed.select(*_BLOCK, part, "longest", *each, F.flatten(_field("items", "vec")).alias(f"{prefix}vecs"))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows in an order in which parents come before children, depth first; each one's parent by place in that order, -1 at the root; the distance to it."""
    n = len(x)
    square = (x * x).sum(axis=1)
    apart = np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0)
    open_, link, far = np.ones(n, bool), np.zeros(n, np.int64), apart[0].copy()
    open_[0] = False
    children: list[list[int]] = [[] for _ in range(n)]
    for _ in range(n - 1):
        i = int(np.argmin(np.where(open_, far, np.inf)))
        open_[i] = False
        children[link[i]].append(i)
        closer = open_ & (apart[i] < far)
        far[closer], link[closer] = apart[i][closer], i
    order, stack, of = [], [0] if n else [], {0: -1}
    while stack:
        i = stack.pop()
        for c in children[i]:
            of[c] = len(order)
            stack.append(c)
        order.append(i)
    order_ = np.array(order, np.int64)
    parent = np.array([of[i] for i in order], np.int64)
    # From the rows themselves: a difference of large squares would not bound anything.
    edge = np.where(parent >= 0, np.sqrt(((x[order_] - x[order_][np.maximum(parent, 0)]) ** 2).sum(axis=1)), 0.0) if n else np.zeros(0)
    return order_, parent, edge


class Walk:
    """Down the tree of a block of anchors, over a block of candidates. Keeps a range of scores for each candidate on the way."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, candidates: np.ndarray) -> None:
        self.anchors, self.parent, self.edge, self.candidates = anchors, parent, edge, candidates
        most = float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, anchors.shape[1])
        if most >= 2**63 and np.abs(anchors.astype(float) @ candidates.astype(float).T).max(initial=0) >= 2**63 * (1 - 1e-9):
            raise OverflowError("an inner product does not fit 64 bits")
        # In floating point where every sum is exact there, else in integers.
        self.exact = most < 2**53
        self.a, self.x = (v.astype(np.float64) if self.exact else v for v in (anchors, candidates))
        self.norm = np.sqrt((candidates.astype(np.float64) ** 2).sum(axis=1)) * (1 + _SLACK)
        self.slack = most * (0 if self.exact else 1e-12) + 1e-6
        self.left = np.bincount(parent[parent >= 0], minlength=len(parent))
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """What the parent's ranges say of anchor i's scores; all that can be, at the root."""
        p = int(self.parent[i])
        if p < 0:
            whole = np.full(len(self.norm), np.inf)
            return -whole, whole
        low, high = self.ranges[p]
        self.left[p] -= 1
        if not self.left[p]:
            del self.ranges[p]
        reach = self.edge[i] * (1 + _SLACK) * self.norm + self.slack
        return low - reach, high + reach

    def score(self, i: int, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact scores of the candidates `which`; they narrow the ranges that anchor i hands down."""
        found = (self.x[which] if 2 * len(which) < len(self.x) else self.x) @ self.a[i]
        exact = (found if len(found) == len(which) else found[which]).astype(np.int64)
        self.scored += len(which)
        if self.left[i]:
            low[which] = high[which] = exact
            self.ranges[i] = (low, high)
        return exact


def best_positives(walk: Walk, ids: np.ndarray, labels: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, candidates' places, scores): of each anchor the k first other rows of its label."""
    for i in range(len(a_ids)):
        low, high = walk.bounds(i)
        own = (labels == a_labels[i]) & (ids != a_ids[i])
        if walk.parent[i] < 0:
            which = np.arange(len(ids))
        else:
            sure = low[own]
            # k candidates score so much at least.
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
            which = np.flatnonzero(own & (high >= least))
        score = walk.score(i, low, high, which)
        mine = own[which]
        which, score = which[mine], score[mine]
        first = np.lexsort((ids[which], -score))[:k]
        if len(first):
            yield i, which[first], score[first]


def best_negatives(walk: Walk, ids: np.ndarray, labels: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, windows: list[list[tuple[int, int, int]]], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor's place, window's number, candidates' places, scores): in each window (number, low, high) of an anchor the k first rows of other labels."""
    for i in range(len(a_ids)):
        low, high = walk.bounds(i)
        asked = [w for w in windows[i] if w[1] <= w[2]]
        other = labels != a_labels[i]
        if walk.parent[i] < 0:
            which = np.arange(len(ids))
        elif asked:
            which = np.flatnonzero(other & (high >= min(w[1] for w in asked)) & (low <= max(w[2] for w in asked)))
        else:
            which = np.zeros(0, np.int64)
        score = walk.score(i, low, high, which)
        there = other[which]
        which, score = which[there], score[there]
        by = np.lexsort((ids[which], -score))
        which, score = which[by], score[by]
        for number, least, most in asked:
            # Scores descend: the first at or below the window's upper end, and on from there.
            at = int(np.searchsorted(-score, -most, "left"))
            end = min(at + k, int(np.searchsorted(-score, -least, "right")))
            if at < end:
                yield i, number, which[at:end], score[at:end]


def _array(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy()


def _matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0), np.int64)


def _meetings(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """blocks (large, kind 0) each followed by the anchors (kind 1) that meet it, whole in one task. asked: anchors' blocks with dim, large, grp and part of a block to meet."""
    names = [*_BLOCK, "part"]
    both = blocks.select(*names, F.lit(0).alias("kind"), "ids", "labels", "vecs").unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, *names).sortWithinPartitions(*names, "kind")


def mine(vectors: DataFrame, how: Mining = Mining(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    A positive is one of the anchor's how.positives first other rows of its label; scores are whole
    inner products, higher first, ties to the smaller id. Its negatives are the how.negatives first rows
    of other labels whose score lies between how.low and how.high hundredths of the positive's, so a
    positive below 0 has none. Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part. Vectors meet those of their own dimension. Rows with the anchor's id aren't
    its positives, nor its negatives unless their label is another; anchors alike in all are one; candidates that repeat may come as
    often. A product beyond 64 bits raises. Other columns are ignored.
    """
    rows = materialize(_dealt(_rows(vectors, id_col, vec_col, label_col, how), how), "mining_rows")
    chosen = rows.where(F.col("id") % how.every == 0).dropDuplicates(["id", "label", "vec"])
    # One narrow row per group: labels that fill a block, and groups of the others.
    sizes = materialize(_parts(rows, how.block_rows, "parts").join(_parts(chosen, how.anchor_rows, "aparts"), _BLOCK, "left"), "mining_groups")
    few = 64 * sizes.count() <= how.small << 20
    sized = lambda df: df.join(F.broadcast(sizes) if few else sizes, _BLOCK)
    blocks = materialize(_packed(sized(rows), "part", "parts", ""), "mining_blocks")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _array(batch, "a_ids", k)
                x = _matrix(_array(batch, "a_vecs", k), len(ids))
                order, parent, edge = spanning_tree(x.astype(np.float64))
                columns = [ids[order], _array(batch, "a_labels", k)[order], x[order].ravel(), parent]
                lists = [pa.array([c], pa.list_(pa.int64())) for c in columns]
                own = [batch.column(c).slice(k, 1) for c in (*_BLOCK, "apart")]
                yield pa.RecordBatch.from_arrays([*own, *lists, pa.array([edge], pa.list_(pa.float64()))], names=[*_BLOCK, "apart", "a_ids", "a_labels", "a_vecs", "parent", "edge"])

    tree = "dim int, large boolean, grp long, apart long, a_ids array<long>, a_labels array<long>, a_vecs array<long>, parent array<long>, edge array<double>"
    anchors = materialize(_packed(sized(chosen), "apart", "aparts", "a_").mapInArrow(plant, tree), "mining_anchors")

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Walk, np.ndarray, np.ndarray]]:
        """Each block of anchors with the block of candidates before it."""
        ids = labels = x = here = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for k in range(batch.num_rows):
                name = tuple(batch.column(c)[k].as_py() for c in (*_BLOCK, "part"))
                if not kind[k]:
                    ids, labels, here = _array(batch, "ids", k), _array(batch, "labels", k), name
                    x = _matrix(_array(batch, "vecs", k), len(ids))
                    continue
                if name != here:
                    continue  # chance dealt no row to this block
                a_ids = _array(batch, "a_ids", k)
                yield batch, k, Walk(_matrix(_array(batch, "a_vecs", k), len(a_ids)), _array(batch, "parent", k), _array(batch, "edge", k), x), ids, labels

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, walk, ids, labels in walks(batches):
            a_ids, a_labels = _array(batch, "a_ids", k), _array(batch, "a_labels", k)
            found = list(best_positives(walk, ids, labels, a_ids, a_labels, how.positives))
            n = sum(len(f[1]) for f in found)
            own = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in (*_BLOCK, "apart")]
            columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in ([np.full(len(f[1]), f[0]) for f in found], [ids[f[1]] for f in found], [f[2] for f in found])]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in columns)], names=[*_BLOCK, "apart", "place", "positive_id", "positive_score"])

    block = [*_BLOCK, "apart"]
    # Anchors meet the blocks of their own group.
    same = sized(anchors).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "aparts")
    met = _meetings(blocks, same).mapInArrow(positives, "dim int, large boolean, grp long, apart long, place long, positive_id long, positive_score long")
    first = F.row_number().over(W.partitionBy(*block, "place").orderBy(F.desc("positive_score"), "positive_id"))
    asked = met.withColumn("number", first.cast("long")).where(F.col("number") <= how.positives)
    # As many as how.positives for each anchor of a block.
    items = F.struct("place", "number", "positive_id", "positive_score")
    wanted = asked.groupBy(*block).agg(F.array_sort(F.collect_list(items)).alias("wanted"))
    each = [_field("wanted", c).alias(f"w_{c}") for c in ("place", "number", "positive_id", "positive_score")]
    told = wanted.select(*block, *each)

    def least_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How long a candidate must be to reach any window of the block."""
        for batch in batches:
            need = []
            for k in range(batch.num_rows):
                ids = _array(batch, "a_ids", k)
                norm = np.sqrt((_matrix(_array(batch, "a_vecs", k), len(ids)).astype(np.float64) ** 2).sum(axis=1))
                score = _array(batch, "w_positive_score", k)
                asked_of = norm[_array(batch, "w_place", k)]
                low = score * (how.low / 100)
                reach = np.where(score < 0, np.inf, np.where(low <= 0, 0.0, low / np.maximum(asked_of, 1e-300)))
                need.append(float(reach.min(initial=np.inf)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need)], names=[*batch.schema.names, "need"])

    seeking = anchors.join(told, block)
    schema = tree + ", w_place array<long>, w_number array<long>, w_positive_id array<long>, w_positive_score array<long>"
    seeking = materialize(seeking.select(*[c.split()[0] for c in schema.split(", ")]).mapInArrow(least_norm, schema + ", need double").withColumn("anchors", F.monotonically_increasing_id()), "mining_windows")
    # Which blocks a block of anchors must meet is told from narrow rows, listed by the chunk.
    listed = blocks.select("dim", "large", "grp", "part", "longest")
    chunks = listed.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / how.chunk).cast("long").alias("chunks"))
    chunk = F.pmod(F.xxhash64("large", "grp", "part"), F.col("chunks"))
    # One row per dimension.
    lists = listed.join(F.broadcast(chunks), "dim").groupBy("dim", chunk.alias("chunk")).agg(F.collect_list(F.struct("large", "grp", "part", "longest")).alias("there"))
    narrow = seeking.select(*block, "need").join(F.broadcast(chunks), "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    other = ~(F.col("large") & F.col("t.large") & (F.col("grp") == F.col("t.grp")))
    pairs = narrow.join(lists, ["dim", "chunk"]).withColumn("t", F.explode("there")).where(other & (F.col("t.longest") * (1 + _SLACK) >= F.col("need") * (1 - _SLACK)))
    pairs = pairs.select(*block, F.col("t.large").alias("t_large"), F.col("t.grp").alias("t_grp"), F.col("t.part").alias("part"))
    to = seeking.drop("need").join(pairs, block).withColumns({"large": F.col("t_large"), "grp": F.col("t_grp")}).drop("t_large", "t_grp")

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, walk, ids, labels in walks(batches):
            a_ids, a_labels = _array(batch, "a_ids", k), _array(batch, "a_labels", k)
            place, positive, score = (_array(batch, f"w_{c}", k) for c in ("place", "positive_id", "positive_score"))
            windows: list[list[tuple[int, int, int]]] = [[] for _ in a_ids]
            for at, (i, s) in enumerate(zip(place.tolist(), score.tolist(), strict=True)):
                windows[i].append((at, -(-how.low * s // 100), how.high * s // 100))
            found = list(best_negatives(walk, ids, labels, a_ids, a_labels, windows, how.negatives))
            size = np.array([len(f[2]) for f in found], np.int64)
            at = np.repeat(np.array([f[1] for f in found], np.int64), size)
            negative, reached = (np.concatenate([np.zeros(0, np.int64), *c]) for c in ([ids[f[2]] for f in found], [f[3] for f in found]))
            number = _array(batch, "w_number", k)
            own = np.full(len(at), batch.column("anchors")[k].as_py())
            columns = [own, place[at], a_ids[place[at]], positive[at], number[at], negative, score[at], reached]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = ["anchors", "place", "anchor_id", "positive_id", "number", "negative_id", "positive_score", "negative_score"]
    found = _meetings(blocks, to).mapInArrow(negatives, ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(W.partitionBy("anchors", "place", "number").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= how.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
