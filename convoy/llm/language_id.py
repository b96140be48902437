"""Language ID by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

Two texts are as alike as the n-grams (n = 1, 2, 3) that both hold, over the root of how
many each holds. A bounded sample of labelled rows gives landmarks and, for each language,
a one-versus-rest ridge regression on the Nystroem features. A score is then the product
of a text's presence row with (landmarks x weights), which is folded into one matrix of
n-grams x languages; batches of texts are multiplied with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.shared import lean
from convoy.llm.text import mix64

U64 = np.uint64
ORDERS = (1, 2, 3)
BITS = 14
FEATURES = len(ORDERS) << BITS


@dataclass(frozen=True)
class Fit:
    """The bounds of what is learned from: at most per_language rows of each language, and about sample_rows in
    all, though one of each language at least; landmarks of them stand for the kernel."""

    per_language: int = 300
    sample_rows: int = 1_200
    landmarks: int = 256
    ridge: float = 1e-2
    sharpness: float = 4.0
    seed: int = 6


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, float32
    sharpness: float


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def presence(text: str) -> np.ndarray:
    """The hashed n-grams that a whole text holds, ascending; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    # A run of anything else counts as one space; the text stands between two.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = letter[0]
    codes = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(U64)
    held = np.zeros(FEATURES, bool)
    value = np.zeros(len(codes), U64)
    for k, n in enumerate(ORDERS):
        value = value[: len(codes) - n + 1] * U64(0x100000001B3) + codes[n - 1 :]
        held[(mix64(value) >> U64(64 - BITS)).astype(np.int64) + (k << BITS)] = True
    return np.flatnonzero(held)


def in_fold(id_col: str, parts: int, part: int) -> Column:
    """crc32(id as text) mod parts is part; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part


def fit(labelled: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from labelled; rows with a null label, or a text that is null or has no letter, don't count.

    Counts cover all rows, texts a bounded sample, drawn by id and text; rows alike in both are drawn
    once. Every label is learned that has a text with a letter; without any, the model is empty.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).cast("string").alias("_label"))
    rows = rows.where(F.col("_text").rlike(r"\p{L}"))
    # One row per label.
    counts = rows.groupBy("_label").count().collect()
    if not counts:
        return Model([], np.zeros((FEATURES, 0), np.float32), how.sharpness)
    each = max(1, min(how.per_language, how.sample_rows // len(counts)))
    # Rows are drawn where they are read: those whose hash falls in the share that gives a third more than needed.
    draw = F.xxhash64(F.lit(how.seed), F.coalesce("_id", F.lit("")), "_text")
    below = F.create_map(*[x for r in counts for x in (F.lit(r["_label"]), F.lit(min(1.0, (1.33 * each + 20) / r["count"])))])
    sample = rows.withColumn("_draw", draw).where(F.pmod("_draw", F.lit(1 << 30)) < below[F.col("_label")] * (1 << 30))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column("_text").to_pylist():
                held = np.zeros(FEATURES, bool)
                held[presence(text)] = True
                bits.append(np.packbits(held).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_label"), batch.column("_draw"), pa.array(bits, pa.binary())], names=["label", "draw", "bits"])

    schema = "label string, draw long, bits binary"
    got = sample.select("_text", "_label", "_draw").mapInArrow(lean(read), schema).dropDuplicates(["label", "draw"]).collect()
    missed = {r["_label"] for r in counts} - {r["label"] for r in got if any(r["bits"])}
    if missed:
        # A label of few different rows: the first of them.
        first = rows.where(F.col("_label").isin(sorted(missed))).groupBy("_label").agg(F.min_by("_text", draw).alias("_text"), F.min(draw).alias("_draw"))
        got += first.select("_text", "_label", "_draw").mapInArrow(lean(read), schema).collect()
    chosen: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["draw"] % (1 << 30), r["draw"], r["bits"])):
        if any(r["bits"]) and len(own := chosen.setdefault(r["label"], [])) < each:
            own.append(bytes(r["bits"]))
    chosen = {name: own for name, own in chosen.items() if own}
    if not chosen:
        return Model([], np.zeros((FEATURES, 0), np.float32), how.sharpness)
    languages = sorted(chosen)
    bits = [(i, b) for rank in range(each) for i, name in enumerate(languages) for b in chosen[name][rank : rank + 1]]
    labels = np.array([i for i, _ in bits])
    packed = np.array([np.frombuffer(b, np.uint8) for _, b in bits])

    def rows_of(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1, count=FEATURES).astype(np.float32)
        return x / np.sqrt(x.sum(axis=1, keepdims=True))

    marks = rows_of(packed[: how.landmarks])
    kernel = np.concatenate([rows_of(packed[i : i + 200]) @ marks.T for i in range(0, len(packed), 200)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[: len(marks)])
    root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    mapped = kernel @ root
    wanted = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + how.ridge * np.eye(len(marks)), mapped.T @ wanted)
    return Model(languages, (marks.T @ (root @ solved)).astype(np.float32), how.sharpness)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns of docs with the predicted language and its score from 0 to 1, from whole texts alone.

    A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned.
    """
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [presence(t or "") for t in part.column(len(keep)).to_pylist()]
                sizes = np.array([len(h) for h in held])
                told = sizes > 0 if model.languages else np.zeros(len(held), bool)
                names_out, score = np.full(len(held), "und", object), np.zeros(len(held))
                if told.any():
                    begin = np.concatenate([[0], np.cumsum(sizes[told])[:-1]])
                    # Presence rows x weights: the rows hold ones only, so the product is a sum of picked weights.
                    value = np.add.reduceat(model.weights[np.concatenate(held)], begin, axis=0) / np.sqrt(sizes[told])[:, None]
                    power = np.exp(model.sharpness * (value - value.max(axis=1, keepdims=True)).astype(np.float64))
                    names_out[told] = np.array(model.languages, object)[value.argmax(axis=1)]
                    score[told] = 1 / power.sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names_out, pa.string()), pa.array(score)], names=[*keep, *names])

    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*keep, F.col(text_col).alias("_text_in")).mapInArrow(lean(run), schema)
