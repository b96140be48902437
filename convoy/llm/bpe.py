"""BPE encoding and decoding by a priority queue of merge ranks over a linked symbol list.

A text is cut at white space, each unit into pieces, and each piece is merged once per Python
worker; units and pieces are remembered.
Merging a piece starts with one symbol per byte; the queue holds adjacent pairs by (rank,
place), a merge relinks its neighbours and pushes the pairs that it makes, and entries whose
pair has changed meanwhile are skipped when they come up. Plain units are cut here; for
others the library says what is a letter, a digit or lower case, as its Unicode has it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convoy.llm.pieces import Remembered, is_plain, plain_pattern
from convoy.llm.shared import give_back, lean
from convoy.llm.text import raw, slices

#: Units, and pieces, that a worker has at hand; those used since the last turn stay for the next.
REMEMBERED = 100_000
#: Fixed: Unicode's White_Space characters, which the tokenizer's \s stands for.
_WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters that str.split() counts as white space but the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer whose file is at path: NFC, white space, lower case; pieces by its pattern; BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.specials.items()]}
        self.split = plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        symbols = byte_symbols()
        self.bytes_of = {ord(s): b for b, s in enumerate(symbols)}
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + suffix] for s in symbols]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.pairs[self.vocab[a] << 20 | self.vocab[b]] = (rank, self.vocab[a + b])
        self.table = np.full(max(self.strings) + 1, "", object)
        self.table[list(self.strings)] = list(self.strings.values())
        self.pieces = Remembered(lambda text: self.piece(text.encode()), REMEMBERED)
        self.units = Remembered(self.unit, REMEMBERED)
        from tokenizers import Tokenizer

        theirs = Tokenizer.from_file(path)
        self.normal, self.cut = theirs.normalizer.normalize_str, theirs.pre_tokenizer.pre_tokenize_str

    def piece(self, data: bytes) -> bytes:
        """Ids of one piece, packed."""
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        pair = self.pairs.get
        queue = [m[0] << 32 | i for i in range(n - 1) if (m := pair(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j == n:
                continue
            found = pair(ids[i] << 20 | ids[j])
            if found is None or found[0] != entry >> 32:
                continue  # stale: one of the two has changed since
            new = ids[i] = found[1]
            ids[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (m := pair(new << 20 | ids[j])) is not None:
                    heappush(queue, m[0] << 32 | i)
            h = before[i]
            if h >= 0 and (m := pair(ids[h] << 20 | new)) is not None:
                heappush(queue, m[0] << 32 | h)
        return array("H", [x for x in ids if x >= 0]).tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of text without white space; special tokens stand for themselves."""
        if is_plain(unit):
            return b"".join(map(self.pieces.__getitem__, self.split(unit.lower())))
        out: list[bytes] = []
        for part in self.special_pattern.split(unit) if self.special_pattern and "<" in unit else [unit]:
            if part in self.specials:
                out.append(array("H", [self.specials[part]]).tobytes())
            elif part:
                out += [self.piece(bytes(map(self.bytes_of.__getitem__, map(ord, symbols)))) for symbols, _ in self.cut(self.normal(part))]
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as int32."""
        self.pieces.turn()
        self.units.turn()
        units = filter(None, _WHITE_SPACE.split(text)) if _SEPARATORS.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.uint16).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings, joined by one space as this tokenizer, which names no decoder, does."""
        return " ".join(self.table[np.asarray(ids, np.int64)].tolist())


@cache
def word_bpe(path: str) -> WordBpe:
    made = WordBpe(path)
    give_back()  # reading the file takes twice what is kept
    return made


def _by_slice(bpe: WordBpe, batches: Iterator[pa.RecordBatch], column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work on a few MB of text at a time, so that results stay small in memory."""
    for batch in batches:
        offsets = raw(batch.column(column))[1]
        for i, j in slices(offsets):
            yield work(batch.slice(i, j - i))
    bpe.units.rest()
    bpe.pieces.rest()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and token_ids; a null or empty text, or one of white space, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))], names=[id_col, "token_ids"])

        return _by_slice(bpe, batches, text_col, work)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """tokens with the column decoded; null ids decode to the empty text."""
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(ids_col)
                flat, bounds = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                texts = [bpe.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return tokens.mapInArrow(lean(run), T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids and decoded in one pass: one Python worker per task in place of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            texts = pa.array([bpe.decode(x) for x in ids], pa.string())
            return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids))), texts], names=[id_col, "token_ids", "decoded"])

        return _by_slice(bpe, batches, text_col, work)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
