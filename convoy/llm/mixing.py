"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's documents stand on a line of words; the line is cut into blocks. A source's
target is an exact quota of block draws: whole passes over its blocks, then a remainder
without replacement. The tree splits the vector of quotas again and again into two halves
until each output shard has its own quotas, every node drawing from the multivariate
hypergeometric distribution, so shards have equal sizes and a fair mix. A keyed permutation
puts the source's block numbers in the order of their draws, and each shard takes the
stretch of that order that the tree gives it: the draws of different shards are disjoint
without any exchange between them. Drawn documents are brought to their shard and shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from convoy.llm.shared import lean, materialize
from convoy.llm.text import U64, mix64, ragged

#: Fixed: the weights that sources take in turn, in code-point order, null last.
WEIGHTS = (3.0, 1.0, 2.0)


@dataclass(frozen=True)
class Mix:
    """share: of all words, what the mix takes. most_passes: no source, and no document, goes beyond it.

    block_words: words in a block; a source's taken words miss its target by less than one
    block for each of its chunks. chunk_rows: about how many documents are laid out by one
    task. shards: outputs. part_words: about how many words of output one task shuffles. seed: of every draw.
    """

    share: float = 1.5
    most_passes: int = 2
    block_words: int = 32
    chunk_rows: int = 5_000
    shards: int = 16
    part_words: int = 1_000_000
    seed: int = 20


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def target_words(sizes: list[int], mix: Mix) -> list[float]:
    """Words for each source, in code-point order: shares by weight; what a source can't give goes to the others by weight."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    most = [float(mix.most_passes * s) for s in sizes]
    left, full = mix.share * sum(sizes), [False] * len(sizes)
    while True:
        open_weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        if not open_weight:
            return most
        each = max(0.0, left - sum(m for m, f in zip(most, full, strict=True) if f)) / open_weight
        over = [not f and w * each > m for w, m, f in zip(weights, most, full, strict=True)]
        if not any(over):
            return [m if f else w * each for w, m, f in zip(weights, most, full, strict=True)]
        full = [f or o for f, o in zip(full, over, strict=True)]


def permuted(block: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at the given places: a balanced Feistel network, walked until it lands in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ U64((key * 4 + r + 1) & (2**64 - 1))) & mask)
        return (left << U64(half)) | right

    x = step(block.astype(U64))
    while len(out := np.flatnonzero(x >= U64(n))):
        x[out] = step(x[out])
    return x.astype(np.int64)


def shard_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact quotas of each shard, from the splitting tree.

    Sums over shards give back the quotas; shard sizes differ by one at most.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def take(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """n draws without replacement from left."""
        got, rest = np.zeros_like(left), int(left.sum())
        for i, c in enumerate(left.tolist()):
            rest -= c
            got[i] = _hypergeometric(rng, c, rest, n)
            n -= int(got[i])
        return got

    def split(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = take(q, total * (mid - lo) // (hi - lo), rng)
        split(left, lo, mid)
        split(q - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact at any size: numpy's generator goes up to 10^9; beyond, two binomials are drawn until they add up to n."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    while True:  # about sqrt(good + bad) draws
        x = rng.binomial(good, p, 1 << 18)
        hit = np.flatnonzero(x + rng.binomial(bad, p, 1 << 18) == n)
        if len(hit):
            return int(x[hit[0]])


@dataclass(frozen=True)
class _Line:
    """Documents on their sources' lines, in columns that begin with the prefix, and what the tree gives each shard.

    ends: shards x sources, where each shard's stretch of a source's order of draws ends.
    """

    rows: DataFrame
    blocks: np.ndarray
    ends: np.ndarray


#: Of the columns added here, so that the columns of docs keep their names.
_P = "__convoy_"
#: Sources up to which their table, of some 100 bytes a row, is broadcast; beyond, it is joined as Spark sees fit.
FEW_SOURCES = 50_000


def _lay_out(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...]) -> _Line:
    spark = docs.sparkSession
    own = {"id": F.col(id_col), "source": F.col(source_col).cast("string"), "size": word_count(text_col), "tie": F.xxhash64(text_col)}
    named = [c.alias(_P + n) for n, c in own.items()]
    sizes = materialize(docs.select(*named), "mix_sizes")
    totals = sizes.groupBy(_P + "source").agg(F.count(F.lit(1)).alias("n"), F.sum(_P + "size").alias("words"))
    # One row per source comes to the driver, which the weights by order need.
    sources = sorted(totals.collect(), key=lambda r: (r[_P + "source"] is None, (r[_P + "source"] or "").encode()))
    targets = target_words([r["words"] for r in sources], mix)
    chunks = [max(1, -(-r["n"] // mix.chunk_rows)) for r in sources]
    table = spark.createDataFrame(
        [(r[_P + "source"], i, c, r["words"], t) for i, (r, c, t) in enumerate(zip(sources, chunks, targets, strict=True))],
        "_source string, _s int, _chunks int, source_size long, target double",
    ).select(F.col("_source"), *[F.col(c).alias(_P + c.strip("_")) for c in ("_s", "_chunks", "source_size", "target")])

    # Spark can't tell the size of rows from the driver, and would shuffle the documents by source.
    table = F.broadcast(table) if len(sources) <= FEW_SOURCES else table

    def dealt(rows: DataFrame) -> DataFrame:
        # A source is laid out in chunks of bounded size, so the hot one is spread over many tasks.
        placed = rows.join(table, rows[_P + "source"].eqNullSafe(table["_source"])).drop("_source")
        what = [F.col(_P + c) for c in ("id", "size", "tie")]
        chunk = F.pmod(F.xxhash64(F.lit(mix.seed + 1), *what), F.col(_P + "chunks").cast("long"))
        return placed.withColumn(_P + "place", F.xxhash64(F.lit(mix.seed), *what)).withColumn(_P + "chunk", chunk).drop(_P + "chunks")

    s, chunk = _P + "s", _P + "chunk"
    per_chunk = materialize(dealt(sizes).groupBy(s, chunk).agg(F.ceil(F.sum(_P + "size") / mix.block_words).cast("long").alias("blocks")), "mix_chunks")
    before = W.partitionBy(s).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_chunk.withColumn(_P + "first", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long"))).drop("blocks")
    counts = {r[s]: r["b"] for r in per_chunk.groupBy(s).agg(F.sum("blocks").alias("b")).collect()}
    blocks = np.array([counts.get(i, 0) for i in range(len(sources))], np.int64)
    words = np.array([r["words"] for r in sources], np.float64)
    mean = np.divide(words, blocks, out=np.ones_like(words), where=blocks > 0)
    quotas = np.minimum(np.rint(np.divide(targets, mean) if len(sources) else np.zeros(0)), mix.most_passes * blocks).astype(np.int64)
    ends = np.cumsum(shard_quotas(quotas, mix.shards, mix.seed), axis=0) if len(sources) else np.zeros((mix.shards, 0), np.int64)
    rows = dealt(docs.select(*keep, *named) if keep else sizes)
    line = W.partitionBy(s, chunk).orderBy(*[_P + c for c in ("place", "id", "size", "tie")]).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(_P + "start", F.coalesce(F.sum(_P + "size").over(line), F.lit(0).cast("long"))).join(offsets, [s, chunk])
    return _Line(rows, blocks, ends)


def _draws(batch: pa.RecordBatch, blocks: np.ndarray, ends: np.ndarray, mix: Mix, whole_documents: bool) -> np.ndarray:
    """Columns (row, first word in the document, words, shard, pass, place), one for each time that a shard draws a block with words of the row."""
    s, start, size, first = (batch.column(_P + c).to_numpy(zero_copy_only=False) for c in ("s", "start", "size", "first"))
    lo = start // mix.block_words
    n = np.where(size > 0, 1 if whole_documents else (start + size - 1) // mix.block_words - lo + 1, 0)
    row = np.repeat(np.arange(len(s)), n)
    local = ragged(lo, n)
    at = np.maximum(local * mix.block_words, start[row]) if not whole_documents else start[row]
    length = np.minimum((local + 1) * mix.block_words, (start + size)[row]) - at if not whole_documents else size[row]
    number, which = local + first[row], s[row]
    out: list[np.ndarray] = []
    for k in np.unique(which):
        here = np.flatnonzero(which == k)
        place = permuted(number[here], int(blocks[k]), mix.seed * 1_000_003 + int(k))
        for again in range(mix.most_passes):
            p = place + again * int(blocks[k])
            shard = np.searchsorted(ends[:, k], p, "right")
            drawn = shard < mix.shards  # beyond the last shard's stretch nobody draws
            h = here[drawn]
            out.append(np.stack([row[h], at[h] - start[row[h]], length[h], shard[drawn], np.full(len(h), again), p[drawn]]))
    draws = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
    return draws[:, np.lexsort((draws[1], draws[4], draws[0]))]


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, whole_documents: bool = False) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, taken, and draws.

    draws holds (block's first word in the document, words, shard, pass, place), one for each
    time that a shard draws a block with words of this document; taken adds up their words. With
    whole_documents, a document belongs with all its words to the block of its first word. Texts
    that are null or have no word have size and taken 0. Null is a source of its own, the last; an
    empty table gives an empty result. Reruns agree: draws depend on ids, texts, sources and the
    seed only. Rows that agree in all of these are alike, so it doesn't matter which comes first.
    """
    line = _lay_out(docs, mix, id_col, text_col, source_col, ())
    blocks, ends = line.blocks, line.ends

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = _draws(batch, blocks, ends, mix, whole_documents)
            taken = np.bincount(draws[0], draws[2], batch.num_rows).astype(np.int64)
            bounds = np.searchsorted(draws[0], np.arange(batch.num_rows + 1)).astype(np.int32)
            kinds = [("at", pa.int64(), 1), ("words", pa.int64(), 2), ("shard", pa.int32(), 3), ("pass", pa.int32(), 4), ("place", pa.int64(), 5)]
            items = pa.StructArray.from_arrays([pa.array(draws[i], kind) for _, kind, i in kinds], [name for name, _, _ in kinds])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(_P + c) for c in ("id", "size", "source", "source_size", "target")), pa.array(taken), pa.ListArray.from_arrays(pa.array(bounds), items)],
                names=[id_col, "size", source_col, "source_size", "target", "taken", "draws"],
            )

    item = T.StructType([T.StructField("at", T.LongType()), T.StructField("words", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("pass", T.IntegerType()), T.StructField("place", T.LongType())])
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("size", T.LongType()),
            T.StructField(source_col, T.StringType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("taken", T.LongType()),
            T.StructField("draws", T.ArrayType(item)),
        ]
    )
    return line.rows.select(*[_P + c for c in ("id", "size", "source", "source_size", "target", "s", "start", "first")]).mapInArrow(lean(draw), schema)


def mixed_shards(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in the mixed proportions, whole documents only: a row for each draw, with its shard (named __convoy_shard) and the columns of docs.

    A document drawn twice comes twice, each time to the shard that drew it. Rows of a shard are
    brought together, over as many partitions as its size asks for, and shuffled there by a keyed
    hash. Documents without words aren't drawn. Rows that repeat an id, or have none, are drawn each
    for itself.
    """
    line = _lay_out(docs, mix, id_col, text_col, source_col, tuple(docs.columns))
    blocks, ends, columns = line.blocks, line.ends, docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(_P + "shard", T.IntegerType()), T.StructField(_P + "order", T.LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = _draws(batch, blocks, ends, mix, whole_documents=True)
            key = batch.column(_P + "place").to_numpy().view(U64)[draws[0]] + draws[4].astype(U64)
            order = mix64(key ^ mix64(np.array([mix.seed + 2], U64))).view(np.int64)
            kept = batch.select(columns).take(pa.array(draws[0]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(draws[3].astype(np.int32)), pa.array(order)], names=names)

    names = schema.names
    drawn = line.rows.select(*docs.columns, *[_P + c for c in ("size", "s", "start", "first", "place")]).mapInArrow(lean(draw), schema)
    parts = max(1, -(-int(ends[-1].sum()) * mix.block_words // mix.part_words)) if ends.size else 1
    # Several partitions to a shard where it is large; several shards to one where they are small.
    per_shard = -(-parts // mix.shards)
    salt = F.pmod(F.col(_P + "order"), F.lit(per_shard))
    return drawn.repartition(parts, _P + "shard", salt).sortWithinPartitions(_P + "shard", salt, _P + "order").drop(_P + "order")


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """mixed_shards without the shards' numbers: rows and columns as in docs."""
    return mixed_shards(docs, mix, id_col, text_col, source_col).select(*docs.columns)
