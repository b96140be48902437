"""Language-model scoring by a weighted backoff automaton.

All words, and all pairs and triples that come `least` times or more, are the model: each
context with followers is a state, a follower is an arc with its discounted probability, and
a failure arc with the backoff weight leads to the state of the next shorter context. The
model grows with the corpus, so its states and arcs are Spark tables. The state before a
word is the longest context in the model that ends there; hence a traversal's sum falls into
one weight for each n-gram that a text passes: a word's own score and its backoff, what a
pair's arc adds to its word's and the pair's own backoff, what a triple's arc adds to its
pair's. Texts meet these weights in parts by the n-gram's hash. `build` makes the same
automaton in memory, for small corpora and tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.shared import fresh_path, materialize, scratch, settled, shuffles_dropped
from convoy.llm.text import U64, from_binary, mix64, raw, slices, spans, word_hashes

#: Words that a task counts before it hands on.
FLUSH = 2_000_000
#: Words of the corpus for each part of the n-grams.
PART = 2_000_000
#: Powers of two, by n. N-grams are dealt in so many rounds, each with its share of the keys: a bound on shuffle files at one time. A round reads all texts.
COUNT_ROUNDS = {1: 1, 2: 1, 3: 2}
SUM_ROUNDS = {1: 1, 2: 1, 3: 1}
#: Bytes of text that are hashed at a time: what that takes stays near the core.
NEAR = 512 << 10
#: Texts of a block, and of one slice of a batch: together below 2^16.
MOST_TEXTS, BATCH_TEXTS = 50_000, 10_000
#: Rows of a batch of counted n-grams.
OUT_ROWS = 100_000
#: Stands for the end of a text.
END = U64(0x6C62272E07BB0142)


@dataclass(frozen=True)
class Order:
    """least: how often a pair or triple of the model comes, whatever the corpus' size. discount: of each one's count.

    hot: an n-gram with at least one of so many training tokens is answered where it is read; there are no more of them than that.
    """

    least: int = 2
    discount: float = 0.5
    hot: int = 1_024


@dataclass(frozen=True)
class Automaton:
    """Words as hashes ascending, K of them; id K is the end. State 0 is the root."""

    words: np.ndarray
    root_score: np.ndarray  # K + 1 log10 probabilities
    root_next: np.ndarray  # K + 1 states
    arc_key: np.ndarray  # state * (K + 1) + word
    arc_score: np.ndarray
    arc_next: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray
    down: np.ndarray  # backoffs from each state to the root, summed

    def traversal(self) -> Callable[[list[int]], float]:
        """A function from a text's word ids (-1: any other word) with the end to its log10 probability without the other words' own."""
        k = len(self.words) + 1
        arcs = dict(zip(self.arc_key.tolist(), zip(self.arc_score.tolist(), self.arc_next.tolist(), strict=True), strict=True)).get
        root_score, root_next = self.root_score.tolist(), self.root_next.tolist()
        fail, backoff, down = self.fail.tolist(), self.backoff.tolist(), self.down.tolist()

        def score(ids: list[int]) -> float:
            state, total = 0, 0.0
            for w in ids:
                if w < 0:
                    total += down[state]
                    state = 0
                    continue
                while state:
                    arc = arcs(state * k + w)
                    if arc is not None:
                        total += arc[0]
                        state = arc[1]
                        break
                    total += backoff[state]
                    state = fail[state]
                else:
                    total += root_score[w]
                    state = root_next[w]
            return total

        return score


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = raw(batch.column("_text"))
    for i, j in slices(offsets, NEAR):
        s, e, bounds = spans(data, offsets[i : j + 1])
        yield i, j, word_hashes(data, s, e, lower=True), bounds


def _counted(docs: DataFrame) -> DataFrame:
    """(k, c): how often each word of the training texts occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "c"])

        for batch in batches:
            for _, _, words, _ in _texts(batch):
                held.append(words)
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return docs.select("_text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _ids(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in the ascending vocabulary; -1 for other words."""
    if not len(vocabulary):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at, -1)


def _log(p: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(p, 1e-300))


def build(words: np.ndarray, word_count: np.ndarray, ends: int, total: int, distinct: int, two: tuple[np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray], order: Order) -> Automaton:
    """two: keys first * (K + 1) + second; three: keys place in two * (K + 1) + third; each with counts."""
    k = len(words) + 1
    counts = np.append(word_count, ends)
    p1 = (counts + 0.5) / (total + 0.5 * (distinct + 1))
    (key2, c2), (key3, c3) = two, three
    first, second = key2 // k, key2 % k
    p2 = (c2 - order.discount) / counts[first]
    base, third = key3 // k, key3 % k
    p3 = (c3 - order.discount) / c2[base] if len(key3) else np.zeros(0)
    # Contexts with followers are states: words first, then pairs.
    of_word = np.zeros(k, np.int64)
    contexts = np.unique(first)
    of_word[contexts] = np.arange(1, len(contexts) + 1)
    of_pair = np.zeros(len(key2), np.int64)
    pairs = np.unique(base)
    of_pair[pairs] = np.arange(len(contexts) + 1, len(contexts) + len(pairs) + 1)
    states = 1 + len(contexts) + len(pairs)
    fail, weight = np.zeros(states, np.int64), np.ones(states)
    left = 1 - np.bincount(first, p2, k)[contexts]
    rest = 1 - np.bincount(first, p1[second], k)[contexts]
    weight[of_word[contexts]] = left / np.maximum(rest, 1e-12)
    if len(pairs):
        shorter = np.searchsorted(key2, second[base] * k + third)  # kept, as it is at least as frequent
        left = 1 - np.bincount(base, p3, len(key2))[pairs]
        rest = 1 - np.bincount(base, p2[shorter], len(key2))[pairs]
        weight[of_pair[pairs]] = left / np.maximum(rest, 1e-12)
        fail[of_pair[pairs]] = of_word[second[pairs]]
    backoff = _log(weight)
    backoff[0] = 0
    down = backoff + np.where(fail > 0, backoff[fail], 0)
    next2 = np.where(of_pair > 0, of_pair, of_word[second])
    next3 = next2[np.searchsorted(key2, second[base] * k + third)] if len(key3) else np.zeros(0, np.int64)
    return Automaton(
        words,
        _log(p1),
        of_word,
        np.concatenate([of_word[first] * k + second, of_pair[base] * k + third]),
        np.concatenate([_log(p2), _log(p3)]),
        np.concatenate([next2, next3]),
        fail,
        backoff,
        down,
    )


def _with_end_words(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and the end, and which text each is of."""
    every = np.insert(words, bounds[1:], END)
    return every, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds) + 1)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * U64(0x9E3779B97F4A7C15) + mix64(right ^ U64(0xD1342543DE82EF95)))


def grams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, text) of every n-gram, the end included.

    A word is both its sides; a pair's sides are its words; a triple's are the keys of its two pairs.
    """
    every, text = _with_end_words(words, bounds)
    if n == 1:
        return every, every, text
    left, right, fits = every[:-1], every[1:], text[:-1] == text[1:]
    if n == 3:
        pair, both = _joined(left, right), fits[:-1] & fits[1:]
        left, right, fits, text = pair[:-1], pair[1:], both, text[:-1]
    return left[fits], right[fits], text[:-1][fits]


def _key(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    return left if n == 1 else _joined(left, right)


def _starts(ascending: np.ndarray) -> np.ndarray:
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def _ascending(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in ascending order, and the keys in it.

    One number holds a key's upper bits and its place, as numbers sort faster than places by a key. Should two keys differ
    in lower bits alone and come out of order, the keys themselves are sorted.
    """
    bits = U64(len(key).bit_length())
    by = (np.sort((key >> bits << bits) | np.arange(len(key), dtype=U64)) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    found = key[by]
    if np.any(found[1:] < found[:-1]):
        by = np.argsort(key)
        found = key[by]
    return by, found


def _place(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; ascends with the keys."""
    return (((key >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int32)


def _cells(place: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts in an ascending array of places."""
    return np.searchsorted(place, np.arange(parts + 1))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(words, bounds, keys of the rows, which are held out) of slices, as lists of about FLUSH words."""
    held, n = [], 0
    for batch in (b.slice(i, BATCH_TEXTS) for b in batches for i in range(0, b.num_rows, BATCH_TEXTS)):
        for i, j, words, bounds in _texts(batch):
            part = batch.slice(i, j - i)
            held.append((words, bounds, part.column("_key").to_numpy().view(U64), part.column("_out").to_numpy(zero_copy_only=False)))
            n += len(words)
            if n >= FLUSH or sum(len(h[2]) for h in held) >= MOST_TEXTS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n: int, turn: int, rounds: int, *, sides: bool) -> tuple[np.ndarray, ...]:
    """(key, text) of the block's n-grams that are dealt in this round, or with their sides (key, left, right)."""
    found, before = [], 0
    for words, bounds, keys, _ in held:
        left, right, text = grams(words, bounds, n)
        key = _key(left, right, n)
        columns = (key, left, right) if sides else (key, (text + before).astype(np.uint16))
        if rounds > 1:
            now = key & U64(rounds - 1) == turn
            columns = tuple(c[now] for c in columns)
        found.append(columns)
        before += len(keys)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def count_grams(rows: DataFrame, n: int, least: int, parts: int, turn: int = 0) -> DataFrame:
    """(k, l, r, c): the n-grams that occur at least `least` times, with their key and sides.

    A task sends each n-gram once per FLUSH words, in arrays; a part counts its own.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            key, left, right = _block(held, n, turn, COUNT_ROUNDS[n], sides=True)
            by, key = _ascending(key)
            left, right = left[by], right[by]
            at = _starts(key)
            c = np.diff(np.append(at, len(key))).astype(np.uint32)
            left, right, cut = left[at], right[at], _cells(_place(key[at], parts), parts)
            has = np.flatnonzero(np.diff(cut))
            cells = [[v[cut[p] : cut[p + 1]].tobytes() for p in has.tolist()] for v in (left, right, c)]
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), *(pa.array(x, pa.binary()) for x in cells)], names=["p", "l", "r", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        left, c = (np.concatenate([from_binary(b.column(x), kind)[0] for b in got]) for x, kind in (("l", U64), ("c", np.uint32)))
        right = np.concatenate([from_binary(b.column("r"), U64)[0] for b in got]) if n > 1 else left
        del got
        if not len(left):
            return
        key = _key(left, right, n)
        by, ascending = _ascending(key)
        at = _starts(ascending)
        total = np.add.reduceat(c[by].astype(np.int64), at)
        keep = total >= least
        first, total = by[at][keep], total[keep]
        for i in range(0, len(first), OUT_ROWS):
            f = first[i : i + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[f].view(np.int64)) for x in (key, left, right)), pa.array(total[i : i + OUT_ROWS])], names=["k", "l", "r", "c"])

    sent = rows.where(~F.col("_out")).select("_text", "_key", "_out").mapInArrow(send, "p int, l binary, r binary, c binary")
    return sent.repartition(parts, "p").mapInArrow(count, "k long, l long, r long, c long")


def hot_weights(weights: DataFrame, total: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, x, y) of the n-grams with a large share of all tokens, ascending: order.hot at most, as their counts add up to no more than all."""
    top = weights.where(F.col("c") * order.hot >= max(1, total)).select("k", "x", "y").toArrow()
    k, x, y = (top.column(c).to_numpy() for c in ("k", "x", "y"))
    by = np.argsort(k.view(U64)) if len(k) else np.zeros(0, np.int64)
    return k.view(U64)[by], x[by], y[by]


def sum_weights(rows: DataFrame, weights: DataFrame, n: int, parts: int, turn: int = 0, hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(key, x, y, found, grams, times): the weights x and y of each row's n-grams in the table (k, x, y), added up.

    found counts the n-grams that are in the table, grams all of this round, times the rows of one key. Rows' n-grams meet
    the table in parts by the key's hash; what a part adds up goes back to the block of rows. Frequent
    n-grams, of which `hot` has the weights, don't travel: each block adds them up itself.
    """
    hot_k, hot_x, hot_y = hot if hot is not None else (np.zeros(0, U64), np.zeros(0), np.zeros(0))

    def added(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Texts, and the sums over their n-grams."""
        found = np.bincount(text)
        has = np.flatnonzero(found)
        sums = [np.bincount(text, v)[has] for v in (x, y)] if len(has) else [np.zeros(0)] * 2
        return [has.astype(np.uint16), *sums, found[has].astype(np.uint32)]

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, x, y = (batch.column(c).to_numpy() for c in ("k", "x", "y"))
            by = np.argsort(k.view(U64))
            k, x, y = k.view(U64)[by], x[by], y[by]
            cut = _cells(_place(k, parts), parts)
            has = np.flatnonzero(np.diff(cut))
            cells = [[v[cut[p] : cut[p + 1]].tobytes() for p in has.tolist()] for v in (k, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.nulls(len(has), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            key, text = _block(held, n, turn, SUM_ROUNDS[n], sides=False)
            rows_of = np.concatenate([h[2] for h in held])
            block = int(mix64(rows_of + np.arange(len(rows_of), dtype=U64)).sum(dtype=U64).view(np.int64))
            grams_of = np.bincount(text, minlength=len(rows_of)).astype(np.uint32)
            by, key = _ascending(key)
            text = text[by]
            at = _starts(key)
            own, times = key[at], np.diff(np.append(at, len(key))).astype(np.uint32)
            # The few frequent ones are looked for among the block's, in place of each of the block's among them.
            place = np.full(len(own), -1)
            met = np.flatnonzero(_ids(own, hot_k) >= 0)
            place[_ids(own, hot_k[met])] = met
            here = place >= 0
            everywhere = np.repeat(here, times)
            hot_of = np.repeat(place[here], times[here])
            own_sums = added(text[everywhere], hot_x[hot_of], hot_y[hot_of])
            own, times, text = own[~here], times[~here], text[~everywhere]
            cut = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[_cells(_place(own, parts), parts)]
            start = _cells(_place(own, parts), parts)
            has = np.flatnonzero(np.diff(start)).tolist()
            # The rows' keys and sizes, and what is added up already, pass through any part.
            through = [block % parts] * 2
            cells = [
                [*(own[start[p] : start[p + 1]].tobytes() for p in has), rows_of.tobytes(), own_sums[0].tobytes()],
                [*(times[start[p] : start[p + 1]].tobytes() for p in has), grams_of.tobytes(), None],
                [*(text[cut[p] : cut[p + 1]].tobytes() for p in has), None, b"".join(v.tobytes() for v in own_sums[1:])],
            ]
            yield pa.RecordBatch.from_arrays([pa.array([*has, *through], pa.int32()), pa.array([block] * (len(has) + 2), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], names=names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part's table comes first and is held; blocks then pass one by one."""
        mine: list[pa.RecordBatch] = []
        table_of: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            is_table = pc.is_null(batch.column("block"))
            if table_of is None:
                mine.append(batch.filter(is_table))
            asked = batch.filter(pc.invert(is_table))
            if not asked.num_rows:
                continue
            if table_of is None:
                k, x, y = (np.concatenate([np.zeros(0, t), *(from_binary(b.column(c), t)[0] for b in mine)]) for c, t in (("a", U64), ("b", np.float64), ("c", np.float64)))
                by = np.argsort(k)
                table_of = k[by], x[by], y[by]
                mine.clear()
            k, x, y = table_of
            for row in asked.select(["block", "a", "b", "c"]).to_pylist():
                if row["c"] is None:
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([row[c]], pa.binary()) for c in ("a", "b")), *(pa.nulls(1, pa.binary()) for _ in range(3))], names=back)
                    continue
                if row["b"] is None:
                    m = len(row["a"]) // 2
                    parts_of = [row["a"], row["c"][: 8 * m], row["c"][8 * m : 16 * m], row["c"][16 * m :]]
                else:
                    place = np.repeat(_ids(k, np.frombuffer(row["a"], U64)), np.frombuffer(row["b"], np.uint32))
                    met = place >= 0
                    text, place = np.frombuffer(row["c"], np.uint16)[met], place[met]
                    parts_of = [v.tobytes() for v in added(text, x[place], y[place])]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.nulls(1, pa.binary()), *(pa.array([v], pa.binary()) for v in parts_of)], names=back)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's answers by text; the texts' keys come once for each block of the same rows."""
        keys: dict[int, np.ndarray] = {}
        grams_of: dict[int, np.ndarray] = {}
        times: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                i = row["block"]
                if row["rows"] is not None:
                    keys[i] = np.frombuffer(row["rows"], U64)
                    grams_of[i] = np.frombuffer(row["t"], np.uint32).astype(np.int64)
                    times[i] = times.get(i, 0) + 1
                    continue
                at = np.frombuffer(row["t"], np.uint16)
                if len(at):
                    into = sums.setdefault(i, np.zeros((3, MOST_TEXTS + BATCH_TEXTS)))
                    for j, (c, kind) in enumerate((("x", np.float64), ("y", np.float64), ("f", np.uint32))):
                        into[j, at] += np.frombuffer(row[c], kind)
        for i, own in keys.items():
            x, y, found = sums.pop(i, np.zeros((3, len(own))))[:, : len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(x), pa.array(y), pa.array(found.astype(np.int64)), pa.array(grams_of[i] * times[i]), pa.array(np.full(len(own), times[i]))], names=["key", "x", "y", "found", "grams", "times"])

    names, back = ["p", "block", "a", "b", "c"], ["block", "rows", "t", "x", "y", "f"]
    schema = "p int, block long, a binary, b binary, c binary"
    asked = rows.select("_text", "_key", "_out").mapInArrow(ask, schema)
    if SUM_ROUNDS[n] > 1:
        weights = weights.where(F.pmod(F.col("k"), F.lit(SUM_ROUNDS[n])) == turn)
    met = weights.select("k", "x", "y").mapInArrow(table, schema).unionByName(asked).repartition(parts, "p").sortWithinPartitions(F.col("block").asc_nulls_first())
    answers = met.mapInArrow(answer, "block long, rows binary, t binary, x binary, y binary, f binary")
    return answers.repartition(parts, "block").mapInArrow(add, "key long, x double, y double, found long, grams long, times long")


def _log_of(p: Column) -> Column:
    return F.log10(F.greatest(p, F.lit(1e-300)))


def _backoff(arcs: DataFrame, shorter: str) -> DataFrame:
    """(l, b): each context's log backoff weight, from its arcs' p and the same followers' shorter p."""
    left, rest = 1 - F.sum("p"), F.greatest(1 - F.sum(shorter), F.lit(1e-12))
    return arcs.groupBy("l").agg(_log_of(left / rest).alias("b"))


def _rounds(table_of: Callable[[int], DataFrame], rounds: int, name: str) -> DataFrame:
    """The rounds' tables, each written before the next one starts."""
    return reduce(DataFrame.unionByName, [materialize(table_of(turn), name) for turn in range(rounds)])


def _weights(rows: DataFrame, words: DataFrame, one: Column, order: Order, parts: int) -> list[DataFrame]:
    """Tables (k, c, x, y) for words, pairs and triples, written. words: (k, c). one: a word's probability by its c."""
    spark = rows.sparkSession
    words = words.withColumn("p1", one)
    paths = [fresh_path(spark, f"lm_weights_{n}") for n in (1, 2, 3)]

    def kept(n: int, df: DataFrame) -> DataFrame:
        df.write.parquet(paths[n - 1])
        return spark.read.schema(df.schema).parquet(paths[n - 1])

    def discounted(n: int, shorter: DataFrame, of: DataFrame, own: str) -> DataFrame:
        """(k, l, c, own, p): counted n-grams, with own of what is right in them and their share of what is left."""
        counted = _rounds(lambda turn: count_grams(rows, n, order.least, parts, turn), COUNT_ROUNDS[n], f"lm_counted_{n}")
        both = counted.join(shorter, "r").join(of.select(F.col("k").alias("l"), F.col("c").alias("of")), "l")
        return both.select("k", "l", "c", own, ((F.col("c") - order.discount) / F.col("of")).alias("p"))

    # The weights stay, so that each is joined once; what led to them goes before the texts ask for them.
    with scratch(spark):
        # What was counted goes once it is joined, so that the disk holds it and the later rounds' shuffles at no time.
        two = settled(spark, "lm_pairs", lambda: discounted(2, words.select(F.col("k").alias("r"), "p1"), words, "p1"))
        context = _backoff(two, "p1").select(F.col("l").alias("k"), "b")
        own = words.join(context, "k", "left").select("k", "c", F.coalesce("b", F.lit(0.0)).alias("b"), _log_of(F.col("p1")).alias("y"))
        first = kept(1, own.select("k", "c", "b", (F.col("y") + F.col("b")).alias("x"), "y"))
        # A kept triple's two pairs are kept, as they are at least as frequent.
        three = settled(spark, "lm_triples", lambda: discounted(3, two.select(F.col("k").alias("r"), F.col("p").alias("p2")), two, "p2"))
        longer = materialize(_backoff(three, "p2"), "lm_pair_backoffs")
        fails = F.col("b") + _log_of(F.col("p1"))
        second = two.join(first.select(F.col("k").alias("l"), "b"), "l").join(longer.select(F.col("l").alias("k"), F.col("b").alias("b2")), "k", "left")
        second = kept(2, second.select("k", "c", (_log_of(F.col("p")) - fails + F.coalesce("b2", F.lit(0.0))).alias("x"), F.lit(0.0).alias("y")))
        third = kept(3, three.join(longer, "l").select("k", "c", (_log_of(F.col("p")) - F.col("b") - _log_of(F.col("p2"))).alias("x"), F.lit(0.0).alias("y")))
    return [first, second, third]


def score_documents(docs: DataFrame, held_out: Column, order: Order = Order(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out says which rows are not learned from, and is false for null. Null texts are
    empty: one token, the end. If nothing is learned from, every token has probability 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_out"))
    train = rows.where(~F.col("_out"))
    counts = materialize(_counted(train), "lm_words")
    ends = train.count()
    seen = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART))
    end = spark.range(1 if ends else 0).select(F.lit(int(END.view(np.int64))).alias("k"), F.lit(ends).cast("long").alias("c"))
    one = (F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1))
    unseen = float(np.log10(0.5 / (total + 0.5 * (distinct + 1))))
    # Rows with one key are alike in id and text: their sums are added up and divided by their number.
    keyed = rows.withColumn("_key", F.xxhash64("_id", F.lit(0), "_text"))
    with shuffles_dropped(spark):
        added = []
        for n, table in enumerate(_weights(keyed, counts.unionByName(end), one, order, parts), 1):
            hot = hot_weights(table, total, order)
            added.append(_rounds(lambda turn, n=n, table=table, hot=hot: sum_weights(keyed, table, n, parts, turn, hot), SUM_ROUNDS[n], f"lm_sums_{n}"))
    zero = F.lit(0).cast("long")
    added[1:] = [df.withColumns({"found": zero, "grams": zero, "times": zero}) for df in added[1:]]
    sums = added[0].unionByName(added[1]).unionByName(added[2]).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("x", "y", "found", "grams", "times")))
    out = keyed.select("_id", "_out", "_key").join(sums, F.col("_key") == F.col("key"))
    tokens, known = ((F.col(c) / F.col("times")).cast("long") for c in ("grams", "found"))
    rest = (tokens - known) * F.lit(unseen)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_out").alias("held_out"),
        tokens.alias("n_tokens"),
        known.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("y") / F.col("times") + rest).alias("base_score"),
        (F.col("x") / F.col("times") + rest).alias("score"),
    )
