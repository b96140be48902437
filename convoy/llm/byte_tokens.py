"""Token ids of whole texts by the public byte-level BPE, one encoder per Python worker.

A single space between two other characters always starts a piece, and a single line end is
one, so most texts are cut there and each unit is encoded once. A plain unit is cut into the
vocabulary's pieces, which recur more often, and the library's model encodes each new piece;
the library encodes other units. A column is cut by Arrow, each distinct unit of a slice of
texts is cut into pieces once, and ids are put together by place. Where white space meets other white space, line ends aren't
cut at; where a space is among it, a plain text is cut into pieces as it stands, and the
library encodes any other whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from convoy.llm.bpe import byte_symbols
from convoy.llm.pieces import Remembered, is_plain, plain_pattern
from convoy.llm.text import ragged, raw, slices

#: Units, and half of the pieces, that a worker has at hand; those used since the last turn stay for the next.
REMEMBERED = 400_000
#: Bytes of text that a column is cut in at a time.
CUT = 8 << 20
_TWO_SPACES = re.compile(r"\s\s")
_NEXT_TO_SPACE = re.compile(r" \s|\s ")
#: Units after which another follows, and last ones, of texts where no white space meets other white space.
_ordinary = re.compile(r"\n?\S+(?:\s\S+)*").fullmatch
_ordinary_end = re.compile(r"\n?(?:\S+(?:\s\S+)*\s?)?").fullmatch


def _packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


@cache
def encoders(path: str) -> tuple[Callable[[str], bytes], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """Two functions: from a text to its ids as uint16, and from a string column to (ids, bounds by text); path: the tokenizer's file. Null texts are empty."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    split = plain_pattern(public_tokenizers.PATTERN)
    model, symbols = tokenizer.model, dict(enumerate(byte_symbols()))

    def whole(text: str) -> bytes:
        return _packed(tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(text: str) -> bytes:
        return _packed([t.id for t in model.tokenize(text.encode().decode("latin-1").translate(symbols))])

    pieces = Remembered(piece, 2 * REMEMBERED)

    def plain(text: str) -> bytes:
        return b"".join(map(pieces.__getitem__, split(text)))

    def as_it_stands(text: str) -> bytes:
        return plain(text) if is_plain(text) else whole(text)

    def after_space(unit: str) -> bytes:
        """A unit stood after its line end, or else after a space."""
        return as_it_stands(unit if unit.startswith("\n") else f" {unit}")

    units = Remembered(after_space, REMEMBERED)
    def encode(text: str) -> bytes:
        pieces.turn()
        units.turn()
        if not _TWO_SPACES.search(text):
            text = text.replace("\n", " \n")
        elif _NEXT_TO_SPACE.search(text):
            return as_it_stands(text)
        first, *rest = text.split(" ")
        return as_it_stands(first) + b"".join(map(units.__getitem__, rest))

    def encode_units(words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units in parts, each unit's first part and the one after its last, and which units are odd, thus have none."""
        spaced = [w if w.startswith("\n") else f" {w}" for w in words]
        odd = np.fromiter((w in ("", "\n") for w in words), bool, len(words))
        alone = np.zeros(len(words), bool)
        joined = "".join(t for t, o in zip(spaced, odd.tolist(), strict=True) if not o)
        if _TWO_SPACES.search(f"{joined} ") or not is_plain(joined):
            odd = np.fromiter((_ordinary(w) is None for w in words), bool, len(words))
            alone = ~odd & np.fromiter((not is_plain(t) for t in spaced), bool, len(words))
            joined = "".join(t for t, o in zip(spaced, (odd | alone).tolist(), strict=True) if not o)
        # White space nowhere meets other, so plain units are cut as one text, in which each begins where a piece has a space or line end first.
        found = split(joined)
        starts = np.flatnonzero(np.fromiter((f[0] == " " or f[0] == "\n" for f in found), bool, len(found)))
        lo, hi = np.zeros((2, len(words)), np.int64)
        lo[~(odd | alone)], hi[~(odd | alone)] = starts, np.append(starts, len(found))[1:]
        lo[alone] = len(found) + np.arange(alone.sum())
        hi[alone] = lo[alone] + 1
        return [*map(pieces.__getitem__, found), *(whole(spaced[k]) for k in np.flatnonzero(alone).tolist())], lo, hi, odd

    def encode_slice(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces.turn()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        parts, lo, hi, odd = encode_units(words)
        # First units, odd last ones, and texts with an odd unit between them are encoded by themselves.
        first, last = bounds[:-1], bounds[1:] - 1
        between = odd[code]
        between[last] = False
        between[first] = False
        alone = np.add.reduceat(between, first, dtype=np.int64) > 0
        own: list[bytes] = []
        known = len(words)
        for t, (i, j) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            head, tail = words[code[i]], words[code[j]]
            if alone[t] or i == j or _TWO_SPACES.search(head) or head[-1:].isspace() or not _ordinary_end(tail):
                alone[t] = True
                own.append(encode(texts[t].as_py()))
                code[i] = known + len(own) - 1
                continue
            own.append(as_it_stands(head))
            code[i] = known + len(own) - 1
            if odd[code[j]]:
                own.append(after_space(tail))
                code[j] = known + len(own) - 1
        by_itself = len(parts) + np.arange(len(own))
        parts += own
        lo, hi = np.append(lo, by_itself), np.append(hi, by_itself + 1)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 2)])
        n = (at[hi] - at[lo])[code]
        if alone.any():
            rest = np.repeat(alone, np.diff(bounds))
            rest[first] = False
            n[rest] = 0
        return np.frombuffer(b"".join(parts), np.uint16)[ragged(at[lo][code], n)], np.concatenate([[0], np.cumsum(np.add.reduceat(n, first))])

    def encode_column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        ids, bounds = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        for i, j in slices(raw(texts)[1], CUT):
            got, ends = encode_slice(texts.slice(i, j - i))
            bounds.append(ends[1:] + bounds[-1][-1])
            ids.append(got)
        return np.concatenate(ids), np.concatenate(bounds)

    return encode, encode_column


def unit_encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as uint16."""
    return encoders(path)[0]


def column_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from a string column to its texts' ids as uint16, laid end to end, and their bounds."""
    return encoders(path)[1]
