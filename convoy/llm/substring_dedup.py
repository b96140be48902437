"""Substring dedup: a log-structured index of fingerprints, merge-joined with each new batch.

A window is a run of `window` words. Of the shorter grams inside each window the one with
the least hash is the window's fingerprint; equal windows have equal fingerprints at equal
places. A batch's fingerprints become an immutable run with one row per fingerprint, in
buckets by hash, each sorted. A new run is merge-joined with each older one, bucket by
bucket, so old runs are never exchanged; that tells which fingerprints repeat, in the batch
or in history. Windows with a repeated fingerprint are then verified by 128 bits over all
their words. When there are too many runs, the two smallest are merged, again bucket by
bucket. An index lives in a folder and can be opened again.

What repeats inside some million rows is settled where it is read, and one row stands for it
in the exchange; settled places go along in one list for each text.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm.shared import fresh_path, materialize, remove
from convoy.llm.text import U64, raw, sequence_hashes, slices, spans, word_hashes


#: Rows that a task settles together before it hands them on.
FLUSH = 1_000_000
#: Rows of a batch handed on.
OUT_ROWS = 100_000


@dataclass(frozen=True)
class Windows:
    """window: words. gram: words of a fingerprint. batches: parts in which documents arrive. most_runs: more are compacted.
    small: MB up to which the places of repeats are broadcast to the texts; beyond, both are shuffled. buckets: of a run;
    0: as many as Spark's shuffle partitions when the index is made."""

    window: int = 35
    gram: int = 10
    batches: int = 4
    most_runs: int = 2
    small: int = 64
    buckets: int = 0


_ID = "_id"
_PLACE_BITS = U64(28)
_PLACE = U64((1 << 28) - 1)


def _selected(grams: np.ndarray, gram_bounds: np.ndarray, bounds: np.ndarray, how: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: the place (among all grams) of its least gram, its text, and its first word there."""
    span = how.window - how.gram + 1
    runs = np.maximum(np.diff(bounds) - how.window + 1, 0)
    text = np.repeat(np.arange(len(runs)), runs)
    start = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    if not len(text):
        return np.zeros(0, np.int64), text, start
    # Hash first, then place: the least is the leftmost of equals, wherever the text stands.
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=U64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (least[gram_bounds[text] + start] & _PLACE).astype(np.int64), text, start


def _listed(key: np.ndarray, at: np.ndarray, beside: int | None = None) -> pa.RecordBatch:
    """Settled places (kind 1): one row for each key, dealt by it, or kept where the hash `beside` lies."""
    by = np.argsort(key, kind="stable")
    key, at = key[by], at[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    m = len(first)
    keys, zeros = pa.array(key[first]), np.zeros(m, np.int64)
    hashes = keys if beside is None else pa.array(np.full(m, beside))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), hashes, pa.array(zeros), keys, pa.array(zeros.astype(np.int32)), pa.array(zeros), places], names=_NAMES)


def _single(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Candidates (kind 0), dealt by their hash."""
    m = len(h1)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(h1), pa.array(h2), pa.array(key), pa.array(at.astype(np.int32)), pa.array(n), pa.nulls(m, pa.list_(pa.int32()))], names=_NAMES)


def _settle(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One candidate for each pair of hashes, with its number; its other rows repeat for certain."""
    by = np.lexsort((h2, h1))
    h1, h2, key, at = h1[by].view(np.int64), h2[by].view(np.int64), key[by], at[by]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    n = np.diff(np.append(np.flatnonzero(new), len(h1)))
    for i in range(0, int(new.sum()), OUT_ROWS):
        f = np.flatnonzero(new)[i : i + OUT_ROWS]
        yield _single(h1[f], h2[f], key[f], at[f], n[i : i + OUT_ROWS])
    yield _listed(key[~new], at[~new])


_NAMES = ["kind", "h1", "h2", "key", "at", "n", "places"]
_ROWS = "kind byte, h1 long, h2 long, key long, at int, n long, places array<int>"


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, h1, h2), so cut that no group of equal hashes is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, kind = batch.column("h1").to_numpy(), batch.column("kind").to_numpy()
        last = _tail(h1, kind)
        if last == 0:
            held.append(batch)
            continue
        yield pa.concat_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _tail(h1: np.ndarray, kind: np.ndarray) -> int:
    """Where the last group begins."""
    other = np.flatnonzero((h1 != h1[-1]) | (kind != kind[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def _meet(rows: DataFrame, parts: int, keep_index: bool) -> DataFrame:
    """Bring candidates of one hash together: kind 1 rows list places that repeat; kind 0, if kept, one per hash for the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            h1, h2, key, at, n = (batch.column(c).to_numpy() for c in ("h1", "h2", "key", "at", "n"))
            kind = batch.column("kind").to_numpy()
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (kind[1:] != kind[:-1])
            group = np.cumsum(new) - 1
            total = np.bincount(group, n)[group].astype(np.int64)
            again = (kind == 0) & (total > 1)
            # Of this task's bucket: by their keys they would go to all buckets, in a file for each.
            yield _listed(key[again], at[again], int(h1[0]))
            yield batch.filter(pa.array(kind == 1))
            if keep_index:
                one = new & (kind == 0)
                yield _single(h1[one], h2[one], key[one], at[one], total[one])

    return rows.repartition(parts, "h1").sortWithinPartitions("kind", "h1", "h2").mapInArrow(run, _ROWS)


def _buckets(spark: SparkSession, path: str, buckets: int) -> tuple[str, DataFrame]:
    """The bucketed files below path, as a table that Spark knows to be so, and its name."""
    name = f"convoy_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (h1 BIGINT, key BIGINT, at INT, n BIGINT, places ARRAY<INT>, kind TINYINT) USING parquet PARTITIONED BY (kind) CLUSTERED BY (h1) SORTED BY (h1) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name, spark.table(name)


class FingerprintIndex:
    """Runs of (h1, key, at, n): a fingerprint, one place of it, and how often it has come. Kept below path, where `open` finds them."""

    def __init__(self, spark: SparkSession, how: Windows = Windows(), path: str | None = None) -> None:
        self.spark, self.how = spark, how
        self.path = path or fresh_path(spark, "fingerprint_index")
        self.buckets = how.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, int, DataFrame]] = []  # folder, batches in it, rows
        self.tables: dict[str, str] = {}  # by folder, while Spark's catalog knows it

    @classmethod
    def open(cls, spark: SparkSession, path: str, how: Windows = Windows()) -> FingerprintIndex:
        """The index that was left at path."""
        index = cls(spark, how, path)
        last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        index.buckets = last["buckets"]
        for r in last["runs"]:
            name, rows = _buckets(spark, f"{path}/{r['folder']}", index.buckets)
            index.tables[r["folder"]] = name
            index.runs.append((r["folder"], r["batches"], rows.where("kind = 0")))
        return index

    def _forget(self, folder: str) -> None:
        """Take a run's table from the catalog; its files stay."""
        if (name := self.tables.pop(folder, None)) is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Leave nothing in the catalog. The index can be opened again from its folder."""
        for folder in list(self.tables):
            self._forget(folder)
        self.runs = []

    def _write(self, rows: DataFrame, batches: int) -> DataFrame:
        """Rows, dealt by h1, as one more folder of buckets; kind 0 of it is a run."""
        folder = f"run-{uuid.uuid4().hex}"
        writer = rows.select("h1", "key", "at", "n", "places", "kind").write.option("path", f"{self.path}/{folder}").partitionBy("kind").bucketBy(self.buckets, "h1").sortBy("h1")
        name = f"convoy_{uuid.uuid4().hex}"
        writer.format("parquet").saveAsTable(name)
        written = self.spark.table(name)
        self.tables[folder] = name
        self.runs.append((folder, batches, written.where("kind = 0")))
        return written

    def _note(self) -> None:
        """What the index consists of now, appended: the last version holds."""
        version = time.time_ns()
        runs = [(folder, batches) for folder, batches, _ in self.runs]
        self.spark.createDataFrame([(version, self.buckets, runs)], "version long, buckets int, runs array<struct<folder:string,batches:int>>").write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-join a batch (key, text) with the index and take it in.

        Returns (key, places): grams, of this batch or of earlier ones, that are now known to
        repeat. Places given twice do no harm.
        """
        how = self.how

        def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                h, key, at = (np.concatenate([f[k] for f in found]) for k in range(3))
                found.clear()
                yield from _settle(h, np.zeros_like(h), key, at)

            for part in batches:
                data, offsets = raw(part.column("text"))
                keys = part.column("key").to_numpy()
                for i, j in slices(offsets):
                    s, e, bounds = spans(data, offsets[i : j + 1])
                    grams, gram_bounds = sequence_hashes(word_hashes(data, s, e, lower=False), bounds, how.gram)
                    place, text, _ = _selected(grams, gram_bounds, bounds, how)
                    first = np.ones(len(place), bool)
                    first[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
                    place, text = place[first], text[first]
                    found.append((grams[place], keys[i:j][text], place - gram_bounds[text]))
                    if sum(len(f[0]) for f in found) >= FLUSH:
                        yield from flush()
            if found:
                yield from flush()

        older = [run for _, _, run in self.runs]
        written = self._write(_meet(batch.mapInArrow(fingerprints, _ROWS), self.buckets, keep_index=True), 1)
        run = self.runs[-1][2]
        places = written.where("kind = 1").select("key", "places")
        for old in older:
            # One row per fingerprint on both sides, in the same buckets.
            both = run.alias("x").join(old.alias("y"), F.col("x.h1") == F.col("y.h1"))
            sides = F.array(F.struct("x.key", "x.at", "x.n"), F.struct("y.key", "y.at", "y.n"))
            again = both.select(F.explode(sides).alias("s")).where("s.n = 1").select("s.key", F.array("s.at").alias("places"))
            places = places.unionByName(again)
        places = materialize(places, "fingerprint_places")
        merged: list[str] = []
        while len(self.runs) > how.most_runs:
            merged += self.compact()
        self._note()
        # What was merged is no longer in the index.
        for folder in merged:
            self._forget(folder)
            remove(self.spark, f"{self.path}/{folder}")
        return places

    def compact(self) -> list[str]:
        """The two smallest runs become one, bucket by bucket; returns the folders of the two."""
        self.runs.sort(key=lambda r: -r[1])
        (first, n, x), (second, m, y) = self.runs.pop(), self.runs.pop()
        x, y = (run.select("h1", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "at", "n")]) for run, side in ((x, "x"), (y, "y")))
        ours = F.col("key_x").isNotNull()
        total = F.coalesce("n_x", F.lit(0).cast("long")) + F.coalesce("n_y", F.lit(0).cast("long"))
        columns = [F.when(ours, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(c) for c in ("key", "at")]
        nothing = F.lit(None).cast("array<int>").alias("places")
        self._write(x.join(y, "h1", "full_outer").select("h1", *columns, total.alias("n"), nothing, F.lit(0).cast("byte").alias("kind")), n + m)
        return [first, second]


def _by_text(places: DataFrame, again: DataFrame | None) -> DataFrame:
    """(key, places) in one list for each text. again (key): texts of several rows, if any, each of which tells the same places."""
    if again is None:
        return places.groupBy("key").agg(F.flatten(F.collect_list("places")).alias("places"))
    # One place is one row, however many rows of the text tell it, so no list is longer than its text.
    each = places.join(again, "key", "left_semi").select("key", F.explode("places").alias("at")).distinct()
    several = each.groupBy("key").agg(F.collect_list("at").alias("places"))
    return _by_text(places.join(again, "key", "left_anti"), None).unionByName(several)


def _verified(touched: DataFrame, how: Windows, again: DataFrame | None) -> DataFrame:
    """(key, starts): first words of windows that occur again, by 128 bits over all their words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([f[k] for f in found]) for k in range(4)]
            found.clear()
            yield from _settle(*columns)

        for part in batches:
            data, offsets = raw(part.column("text"))
            keys = part.column("key").to_numpy()
            lists = part.column("places")
            for i, j in slices(offsets):
                s, e, bounds = spans(data, offsets[i : j + 1])
                words = word_hashes(data, s, e, lower=False)
                grams, gram_bounds = sequence_hashes(words, bounds, how.gram)
                place, text, start = _selected(grams, gram_bounds, bounds, how)
                repeated = np.zeros(len(grams) + 1, bool)
                for k in range(j - i):
                    repeated[gram_bounds[k] + lists[i + k].values.to_numpy()] = True
                asked = np.flatnonzero(repeated[place])
                h1, window_bounds = sequence_hashes(words, bounds, how.window, seed=3)
                h2, _ = sequence_hashes(word_hashes(data, s, e, lower=False, seed=1), bounds, how.window, seed=4)
                at = window_bounds[text[asked]] + start[asked]
                found.append((h1[at], h2[at], keys[i:j][text[asked]], start[asked]))
                if sum(len(f[0]) for f in found) >= FLUSH:
                    yield from flush()
        if found:
            yield from flush()

    parts = int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _meet(touched.select("key", "text", "places").mapInArrow(windows, _ROWS), parts, keep_index=False)
    return _by_text(met.select("key", "places"), again).withColumnRenamed("places", "starts")


def remove_repeats(docs: DataFrame, how: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text", *, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, removed, and kept_text or its kept_sha256.

    Each word covered by a window that also starts anywhere else goes; windows are judged on
    the input. removed holds the ranges [from, to) of words. Null texts have no words. Texts
    shorter than a window lose nothing. Rows that repeat an id and text are two documents.
    """
    kept_name = "kept_text" if keep_text else "kept_sha256"
    rows = docs.select(F.col(id_col).alias(_ID), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(_ID, F.lit(0), "text"))
    again: DataFrame | None = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "texts_of_several_rows")
    several = again.count()
    again = None if not several else F.broadcast(again) if 16 * several <= how.small << 20 else again
    index = FingerprintIndex(docs.sparkSession, how)
    places: DataFrame | None = None
    for k in range(how.batches):
        arrived = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(how.batches)) == k).select("key", "text")
        new = index.add(arrived)
        places = new if places is None else places.unionByName(new)
    by_text = materialize(_by_text(places, again), "places_by_text")
    # This index is the job's own, and done.
    index.close()
    remove(docs.sparkSession, index.path)
    size = by_text.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("places")).first()
    if 32 * size["n"] + 4 * (size["places"] or 0) <= how.small << 20:
        marked = rows.join(F.broadcast(by_text), "key", "left")
    else:
        marked = materialize(rows.join(by_text, "key", "left"), "marked")
    touched = marked.where("places is not null")
    found = _verified(touched, how, again)

    def render(words: list[bytes]) -> str:
        joined = b" ".join(words)
        return joined.decode() if keep_text else hashlib.sha256(joined).hexdigest()

    id_type = docs.schema[id_col].dataType.simpleString()
    ranges = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    schema = f"{_ID} {id_type}, n_words long, n_removed long, removed array<struct<from:int,to:int>>, kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts"), strict=True):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, np.int64)
                    if starts.is_valid:
                        first = starts.values.to_numpy().astype(np.int64)
                        np.add.at(change, first, 1)
                        np.add.at(change, first + how.window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out[0].append(len(words))
                    out[1].append(int(gone.sum()))
                    out[2].append([{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    out[3].append(render([words[i] for i in np.flatnonzero(~gone)] if len(edges) else words))
                yield pa.RecordBatch.from_arrays([part.column(_ID), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], ranges), pa.array(out[3], pa.string())], names=[_ID, "n_words", "n_removed", "removed", "kept"])

    none = F.lit(None).cast("array<int>").alias("starts")
    untouched = marked.where("places is null").select(_ID, "text", none).mapInArrow(cut, schema)
    cuts = touched.select(_ID, "key", "text").join(found, "key", "left").select(_ID, "text", "starts").mapInArrow(cut, schema)
    return untouched.unionByName(cuts).select(F.col(_ID).alias(id_col), "n_words", "n_removed", "removed", F.col("kept").alias(kept_name))
