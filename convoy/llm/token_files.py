"""Token-ID output: documents as range-coded token files in ascending id order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from convoy.llm import rans
from convoy.llm.byte_tokens import column_encoder
from convoy.llm.shared import fresh_path


@dataclass(frozen=True)
class TokenFiles:
    """docs_per_file: about how many documents one file holds, and half of the most. file_tokens, block_tokens: a file, a block, ends with the document that reaches it.

    lanes: interleaved coders in a block. checkpoint_steps: steps between checkpoints.
    """

    end_id: int = 2
    docs_per_file: int = 2_000
    file_tokens: int = 1 << 23
    block_tokens: int = 1 << 17
    lanes: int = 1_024
    checkpoint_steps: int = 64


def write_token_files(docs: DataFrame, tokenizer: str, how: TokenFiles = TokenFiles(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write their files; returns the files, one row each, as read back.

    Columns: file (ascending as the ids), n_tokens, ids and sizes (of the documents inside),
    content (the file's bytes). Null texts are empty; each document ends with end_id. Null
    ids come first; rows with one id are ordered by a hash of their texts, and alike ones by
    where they are read, so that neither share a file beyond its bounds.
    """
    spark = docs.sparkSession
    # Spark finds the ranges from a sample of the rows' keys; a task's range is one file, unless it reaches a file's bounds.
    ranges = max(1, -(-docs.count() // how.docs_per_file))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    end = np.uint16(how.end_id).tobytes()

    def pack(file: int, ids: list[int | None], docs_tokens: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) // 2 for t in docs_tokens], np.int64)
        flat = np.frombuffer(b"".join(docs_tokens), np.uint16).astype(np.uint32)
        ends = np.cumsum(sizes)
        blocks, begin = [], 0
        while begin < len(flat):
            k = min(int(np.searchsorted(ends, begin + how.block_tokens, "left")), len(ends) - 1)
            blocks.append(flat[begin : ends[k]])
            begin = int(ends[k])
        content = rans.write_file(blocks, how.lanes, how.checkpoint_steps)
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([content], pa.binary())],
            names=["file", "n_tokens", "ids", "sizes", "content"],
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: one file's documents are held at a time."""
        encode = column_encoder(tokenizer)
        # The task's place in the order of ranges, then the file's place in it.
        file = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0
        for batch in batches:
            flat, bounds = encode(batch.column("_text"))
            for i, lo, hi in zip(batch.column("_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                tokens = flat[lo:hi].tobytes() + end
                ids.append(i)
                held.append(tokens)
                size += len(tokens) // 2
                if size >= how.file_tokens or len(held) >= 2 * how.docs_per_file:
                    yield pack(file, ids, held)
                    file, ids, held, size = file + 1, [], [], 0
        if held:
            yield pack(file, ids, held)

    schema = "file long, n_tokens long, ids array<long>, sizes array<long>, content binary"
    path = fresh_path(spark, "token_files")
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("_id", "_text").mapInArrow(write, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_token_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files' bytes: id, start, n_tokens, ids_crc32, and token_ids if asked for.

    start counts the ids of all documents before, over all files.
    """
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    # One narrow row per file.
    offsets = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("_before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table, blocks = rans.read_file(batch.column("content")[k].as_py())
                looked = rans.decoder(table)
                ids, sizes = batch.column("ids")[k].as_py(), np.array(batch.column("sizes")[k].as_py(), np.int64)
                ends = np.cumsum(sizes)
                done, begin = 0, 0
                for block in blocks:
                    flat = rans.decode(block, looked).astype("<u4")
                    stop = int(np.searchsorted(ends, begin + len(flat), "right"))
                    lo, hi = (ends - sizes)[done:stop] - begin, ends[done:stop] - begin
                    crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(lo, hi, strict=True)]
                    out = [pa.array([batch.column("file")[k].as_py()] * len(crc), pa.int64()), pa.array(ids[done:stop], pa.int64()), pa.array(lo + begin), pa.array(sizes[done:stop]), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([lo, hi[-1:]]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    done, begin = stop, begin + len(flat)

    fields = [("file", T.LongType()), ("_id", T.LongType()), ("_local", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType())))
    names = [n for n, _ in fields]
    rows = files.select("file", "ids", "sizes", "content").mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in fields]))
    more = ["token_ids"] if with_ids else []
    return rows.join(offsets, "file").select(F.col("_id").alias(id_col), (F.col("_before") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32", *more)
