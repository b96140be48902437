"""Suffix-array dedup: bucket-pointer refinement of sampled suffixes.

A window is `window` bytes of one text. Its anchor is the q-gram inside it with the least
identifier, so equal windows have equal anchors at equal offsets, and only anchors need sorting:
some three of a hundred bytes. Initial buckets are the anchors' q-grams. Identifiers of longer
stretches are made from those of half the length here and at a later offset, each used again
for the next. Within a bucket suffixes are told apart by the identifier of all text that the
anchor's windows span: alike suffixes repeat whole, but for the first; a bucket in which all
are alike is done. What is left open is refined: its windows are divided by their offset to the
anchor, which lets each part's bucket be a longer stretch, until a part is one window.

Each level is one exchange. What a task can settle among some million suffixes never travels;
of a bucket that it finds to be divided only a mark does. So a frequent q-gram has a row or
two for each such million, not one for each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.shared import materialize
from convoy.llm.text import U64, mix64, raw


@dataclass(frozen=True)
class Suffixes:
    """window: bytes. gram: q, bytes of an initial bucket. parts: into how many ranges of offsets each level divides an anchor's windows; a last level has one offset each.

    flush: suffixes that a task sorts together. stretch: bytes of text identified at once. small: MB up to
    which lists of places are broadcast to the texts; beyond, both are shuffled.
    """

    window: int = 100
    gram: int = 24
    parts: tuple[int, ...] = (1, 2)
    flush: int = 1_000_000
    stretch: int = 2 << 20
    small: int = 64

    @property
    def offsets(self) -> int:
        return self.window - self.gram + 1


_STEP, _TURN, _ADD = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_BYTES = mix64(np.arange(1, 257, dtype=U64) * _STEP)
_PLACE = U64((1 << 24) - 1)
#: A place is start << 16 | windows << 8 | offset of the first window to the anchor.
_NAMES = ["kind", "h", "c", "doc", "key", "place", "places"]
_ROWS = "kind byte, h long, c long, doc long, key long, place long, places array<long>"
#: One suffix of a bucket; a mark that its bucket is divided; places of a text that repeat; places that are open.
_SUFFIX, _MARK, _REPEATED, _OPEN = 0, 1, 2, 3
_LATE = np.iinfo(np.int64).max


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of two stretches, from theirs."""
    x = (a * _STEP) ^ (b * _TURN + _ADD)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


class _Identifiers:
    """Identifiers of all stretches of some bytes, of any length up to twice the largest power of two kept."""

    def __init__(self, data: np.ndarray, longest: int) -> None:
        self.of = {1: _BYTES[data]}
        k = 1
        while 2 * k <= longest and len(self.of[k]) > k:
            self.of[2 * k] = _joined(self.of[k][:-k], self.of[k][k:])
            if k < 16:
                del self.of[k]
            k *= 2

    def at(self, start: np.ndarray | slice, length: int) -> np.ndarray:
        """Of the stretches of `length` bytes that begin at start (16 bytes at least)."""
        k = max(x for x in self.of if x <= length)
        own = self.of[k]
        if k == length:
            return own[start]
        if isinstance(start, slice):
            n = len(own) - (length - k)
            return _joined(own[:n], own[length - k :])
        return _joined(own[start], own[start + (length - k)])


def _anchors(ids: _Identifiers, n: int, how: Suffixes) -> np.ndarray:
    """For each window of n bytes, the place of its anchor: of least grams the leftmost."""
    grams = ids.at(slice(None), how.gram)
    least = (grams >> U64(24) << U64(24)) | np.arange(len(grams), dtype=U64)
    width = 1
    while 2 * width <= how.offsets:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < how.offsets:
        least = np.minimum(least[: len(least) - (how.offsets - width)], least[how.offsets - width :])
    return (least & _PLACE).astype(np.int64)


def _stretches(offs: np.ndarray, how: Suffixes) -> Iterator[tuple[int, int, int]]:
    """(from, to, windows end) in bytes: stretches of about how.stretch bytes; of a longer text the windows are divided over several."""
    at, end = int(offs[0]), int(offs[-1])
    while at < end:
        to = min(end, at + how.stretch)
        yield at, min(end, to + how.window - 1), to
        at = to


def _owned(data: np.ndarray, offs: np.ndarray, how: Suffixes) -> Iterator[tuple[_Identifiers, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch: identifiers, its first byte, and of each run of windows with one anchor: text, start, number, offset to the anchor."""
    for a, b, last in _stretches(offs, how):
        if b - a < how.window:
            continue
        ids = _Identifiers(data[a:b], how.window)
        owner = _anchors(ids, b - a, how)
        start = np.arange(a, a + len(owner))
        text = np.searchsorted(offs, start, "right") - 1
        inside = (start + how.window <= offs[text + 1]) & (start < last)
        start, text, owner = start[inside], text[inside], owner[inside] + a
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        yield ids, a, text[first], start[first], np.diff(np.append(first, len(start))), owner[first] - start[first]


def _suffixes(ids: _Identifiers, base: int, start: np.ndarray, n: np.ndarray, offset: np.ndarray, parts: int, how: Suffixes) -> tuple[np.ndarray, ...]:
    """(h, c, start, n, offset, from which) of runs of windows divided by offset into parts: bucket and identifier of each.

    Windows of one part have offsets between low and high; they share the stretch from anchor - low
    to anchor - high + window, which is the part's bucket.
    """
    width = -(-how.offsets // parts)
    lead, last = offset // width, (offset - n + 1) // width
    count = lead - last + 1
    which = np.repeat(np.arange(len(start)), count)
    part = lead[which] - (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
    anchor = start[which] + offset[which]
    low, high = part * width, np.minimum((part + 1) * width, how.offsets) - 1
    far = np.minimum(offset[which], high)
    near = np.maximum(offset[which] - n[which] + 1, low)
    begin, windows = anchor - far, far - near + 1
    whole = how.window
    h = np.zeros(len(which), U64)
    for length in np.unique(whole - (high - low)):
        of = whole - (high - low) == length
        h[of] = ids.at((anchor - low)[of] - base, int(length))
    c = _joined(_joined(ids.at(begin - base, whole), ids.at(begin + windows - 1 - base, whole)), (windows.astype(U64) << U64(8)) | far.astype(U64))
    # The bucket names its part, too.
    return _joined(h, part.astype(U64) + U64(parts << 8)), c, begin, windows, far, which


def _batch(kind: int, h: np.ndarray, c: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    m = len(h)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(h), pa.array(c), pa.array(doc), pa.array(key), pa.array(place), pa.nulls(m, pa.list_(pa.int64()))], names=_NAMES)


def _listed(kind: int, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row for each text with its places, dealt by the text."""
    by = np.lexsort((place, key, doc))
    doc, key, place = doc[by], key[by], place[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    zeros = np.zeros(len(first), np.int64)
    dealt = mix64((doc[first].view(U64) * _STEP) ^ key[first].view(U64)).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int8)), pa.array(dealt), pa.array(zeros), pa.array(doc[first]), pa.array(key[first]), pa.array(zeros), lists], names=_NAMES)


#: Rows of a batch handed on, and rows of buckets looked at together.
_OUT = 100_000


def _settled(h: np.ndarray, c: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray, marks: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    """Sort suffixes within their buckets. The first of those alike stays, the others repeat.

    With marks None, as before the exchange, what stays of an undivided bucket goes on. After it, such
    a bucket is done; marks says which rows are marks only. What stays of a divided bucket is open.
    """
    only = np.zeros(len(h), bool) if marks is None else marks
    by = np.lexsort((place, key, doc, c, h) if marks is None else (place, key, doc, c, only, h))
    h, c, doc, key, place, only = h[by], c[by], doc[by], key[by], place[by], only[by]
    bucket = np.ones(len(h), bool)
    bucket[1:] = h[1:] != h[:-1]
    alike = bucket.copy()
    alike[1:] |= (c[1:] != c[:-1]) | (only[1:] != only[:-1])
    group = np.cumsum(bucket) - 1
    divided = np.bincount(group, alike)[group] > 1
    repeats = ~alike & ~only
    yield _listed(_REPEATED, doc[repeats], key[repeats], place[repeats])
    stays = alike & ~only
    if not last:
        open_now = stays & divided
        yield _listed(_OPEN, doc[open_now], key[open_now], place[open_now])
    if marks is None:
        # At the last level a bucket that isn't alike is another one by chance, and is told apart after the exchange as well.
        for kind, those in ((_SUFFIX, np.flatnonzero(stays if last else stays & ~divided)), (_MARK, np.flatnonzero(bucket & divided) if not last else np.zeros(0, np.int64))):
            for i in range(0, len(those), _OUT):
                t = those[i : i + _OUT]
                if kind == _SUFFIX:
                    yield _batch(kind, h[t], c[t], doc[t], key[t], place[t])
                else:
                    none = np.zeros(len(t), np.int64)
                    yield _batch(kind, h[t], none, none, none, none)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, so cut that no bucket is divided."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        other = np.flatnonzero(h != h[-1])
        rows += batch.num_rows
        if not len(other) or rows < _OUT:
            held.append(batch)
            continue
        cut = int(other[-1]) + 1
        yield pa.concat_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
        rows = batch.num_rows - cut
    if held:
        yield pa.concat_batches(held)


def _level(texts: DataFrame, parts: int, last: bool, how: Suffixes) -> DataFrame:
    """One level over texts (doc, key, text, and places if not the first): rows of kinds _REPEATED and _OPEN."""
    given = "places" in texts.columns

    def sort_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([f[k] for f in found]) for k in range(5)]
            found.clear()
            yield from _settled(*columns, None, last)

        for batch in batches:
            doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            data, offs = raw(batch.column("text"))
            lists = batch.column("places") if given else None
            for i, j in _texts(offs, how):
                runs = _owned(data, offs[i : j + 1], how) if lists is None else _given(data, offs[i : j + 1], lists.slice(i, j - i), how)
                for ids, base, text, start, n, offset in runs:
                    h, c, begin, windows, far, which = _suffixes(ids, base, start, n, offset, parts, how)
                    of = text[which]
                    place = (begin - offs[i + of]) << 16 | windows << 8 | far
                    found.append((h.view(np.int64), c.view(np.int64), doc[i:j][of], key[i:j][of], place))
                    if sum(len(f[0]) for f in found) >= how.flush:
                        yield from flush()
        if found:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_buckets(batches):
            kind = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kind >= _REPEATED))
            here = kind <= _MARK
            if here.any():
                columns = [batch.column(c).to_numpy()[here] for c in ("h", "c", "doc", "key", "place")]
                yield from _settled(*columns, kind[here] == _MARK, last)

    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(sort_here, _ROWS)
    met = rows.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(meet, _ROWS)
    return materialize(met.select("kind", "doc", "key", "places"), f"suffixes_{parts}")


def _texts(offs: np.ndarray, how: Suffixes) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about how.stretch bytes, one text at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + how.stretch, "right")) - 1)
        yield i, min(j, n)
        i = j


def _given(data: np.ndarray, offs: np.ndarray, lists: pa.Array, how: Suffixes) -> Iterator[tuple[_Identifiers, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As `_owned`, for the open places that are listed for each text."""
    place = lists.flatten().to_numpy()
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    start = (place >> 16) + offs[text]
    by = np.argsort(start, kind="stable")
    place, text, start = place[by], text[by], start[by]
    for a, b, last in _stretches(offs, how):
        i, j = np.searchsorted(start, (a, last))
        if i < j:
            b = min(b + how.window, int(offs[-1]))
            yield _Identifiers(data[a:b], how.window), a, text[i:j], start[i:j], place[i:j] >> 8 & 255, place[i:j] & 255


def _by_text(found: DataFrame) -> DataFrame:
    return found.groupBy("doc", "key").agg(F.flatten(F.collect_list("places")).alias("places"))


def _joined_by_text(texts: DataFrame, lists: DataFrame, how: Suffixes, kind: str) -> DataFrame:
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("places")).first()
    few = 48 * size["n"] + 8 * (size["places"] or 0) <= how.small << 20
    return texts.join(F.broadcast(lists) if few else lists, ["doc", "key"], kind)


def _merged(lists: DataFrame, how: Suffixes) -> DataFrame:
    """(doc, key, places): byte ranges from << 32 | length that places cover, apart from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places"):
                place = np.sort(places.values.to_numpy())
                begin, end = place >> 16, (place >> 16) + (place >> 8 & 255) - 1 + how.window
                end = np.maximum.accumulate(end)
                new = np.ones(len(begin), bool)
                new[1:] = begin[1:] > end[:-1]
                first = np.flatnonzero(new)
                stop = end[np.append(first[1:] - 1, len(end) - 1)] if len(end) else end
                out.append(begin[first] << 32 | (stop - begin[first]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(out, pa.list_(pa.int64()))], names=["doc", "key", "places"])

    return lists.mapInArrow(run, "doc long, key long, places array<long>")


def _units(rows: DataFrame, how: Suffixes) -> tuple[DataFrame, DataFrame]:
    """rows (doc, text, and others) with key, and the texts (doc, key, text) to compare: rows that repeat id and text are one.

    An id of one row has key 0; rows that share an id are told apart by their text's hash.
    """
    shared = materialize(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "shared_ids")
    n = shared.count()
    if not n:
        keyed = rows.withColumn("key", F.lit(0).cast("long"))
        return keyed, keyed.select("doc", "key", "text")
    marks = shared.withColumn("_shared", F.lit(True))
    marked = rows.join(F.broadcast(marks) if 32 * n <= how.small << 20 else marks, "doc", "left")
    keyed = marked.withColumn("key", F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    texts = keyed.where("_shared is null").select("doc", "key", "text").unionByName(keyed.where("_shared").select("doc", "key", "text").dropDuplicates(["doc", "key"]))
    return keyed.drop("_shared"), texts


def repeated_ranges(texts: DataFrame, how: Suffixes = Suffixes()) -> DataFrame:
    """(doc, key, places): for each text (doc, key, text) with any, the byte ranges from << 32 | length that windows cover which also start earlier."""
    level, repeated = texts, None
    for k, parts in enumerate((*how.parts, how.offsets)):
        last = k == len(how.parts)
        found = _level(level, parts, last, how)
        now = found.where(f"kind = {_REPEATED}").select("doc", "key", "places")
        repeated = now if repeated is None else repeated.unionByName(now)
        if not last:
            still = materialize(_by_text(found.where(f"kind = {_OPEN}")), "open_suffixes")
            level = _joined_by_text(texts, still, how, "inner")
    return materialize(_merged(_by_text(repeated), how), "repeated_ranges")


def _ids(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(_LATE))


def remove_repeats(docs: DataFrame, how: Suffixes = Suffixes(), id_col: str = "doc_id", text_col: str = "text", *, keep_bytes: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, removed, and kept (bytes) or its kept_sha256.

    Texts are their UTF-8 bytes; null is empty. Each byte covered by a window that also starts earlier
    goes: in a document of smaller id, or earlier in its own; windows are judged on the input. removed
    holds the ranges [from, to) of bytes, which may divide a character, so kept is binary. Texts shorter
    than a window lose nothing themselves. Rows without an id come after all others; rows that share an
    id come in the order of their texts' hashes; rows that repeat id and text are one document, and each
    gets its result. Ids are integers. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), _ids(F.col(id_col)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, texts = _units(rows, how)
    ranges = repeated_ranges(texts.where(F.octet_length("text") >= how.window), how)
    marked = _joined_by_text(keyed, ranges, how, "left")
    kept_name, kept_type = ("kept", "binary") if keep_bytes else ("kept_sha256", "string")
    removed_type = "array<struct<from:int,to:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for text, places in zip(part.column("text").to_pylist(), part.column("places"), strict=True):
                    data, pieces, done = text.encode(), [], 0
                    spans = [(p >> 32, (p >> 32) + (p & 0xFFFFFFFF)) for p in places.as_py()]
                    for a, b in spans:
                        pieces.append(data[done:a])
                        done = b
                    kept = b"".join([*pieces, data[done:]])
                    out[0].append(len(data))
                    out[1].append(len(data) - len(kept))
                    out[2].append([{"from": a, "to": b} for a, b in spans])
                    out[3].append(kept if keep_bytes else hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], spans_type), pa.array(out[3], pa.binary() if keep_bytes else pa.string())], names=["_id", "n_bytes", "n_removed", "removed", kept_name])

    id_type = docs.schema[id_col].dataType.simpleString()
    touched = marked.where("places is not null").select("_id", "text", "places").mapInArrow(cut, f"_id {id_type}, n_bytes long, n_removed long, removed {removed_type}, {kept_name} {kept_type}")
    # Texts that lose nothing stay with Spark.
    data = F.encode("text", "UTF-8")
    whole = marked.where("places is null").select("_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(removed_type).alias("removed"), (data if keep_bytes else F.sha2(data, 256)).alias(kept_name))
    both = touched.unionByName(whole)
    return both.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "removed", kept_name)
