"""N-gram Jaccard join: a blocked sparse product of the document x n-gram incidence with its transpose.

The columns (n-grams) are put in one global order, rare before frequent. By the size bound,
two documents that are alike enough share columns among the first few of each; those
columns are the first block. The product over it yields candidate pairs with their overlap so
far; pairs whose overlap plus what sizes and places leave stays under the bound are discarded,
and whole sets decide about the others.

Within a group of near copies every document shares columns with every other, so the product
is formed twice. Each document is first held against one hub, the document that meets most
others in its columns; one that is half alike at least belongs to the hub's group, and is known
by the few columns in which it differs from the hub. Two documents of one group differ by at
least what their differences don't share. So the second product is over differences, again rare
before frequent and with size-derived bounds, and only for pairs that the hub doesn't link
already; the product over whole documents is left for pairs of different groups. Documents of a group
that its hub doesn't link may be near copies of each other and differ from the hub alike: they are held
against hubs of their own, round by round, until none finds a partner so, and what is one family then
doesn't meet itself in the second product.

All this is done once for each class of texts of the same words, under a number of its own; rows that repeat
are one class, and texts that share an id are classes that the id links in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.llm.components import components
from convoy.llm.shared import lean, materialize, shuffles_dropped
from convoy.llm.text import U64, binary_column, from_binary, mix64, raw, sequence_hashes, slices, spans, word_hashes


@dataclass(frozen=True)
class Likeness:
    """Shingles of so many words; linked when per * intersection >= least * union.

    A shingle that local_heavy documents of one batch share counts as frequent, and about the
    known_heavy most frequent are ordered by how many documents hold them. Any order of
    shingles gives the same links; this one keeps frequent ones out of the first block.
    meets: how many columns of the first block linked documents share at least. few: ids up to
    which a join is by broadcast. hub_share: documents of a group that one copy of its hub serves.
    hub_columns: how many columns of the first block name a hub at least for a document to be held against it.
    """

    words: int = 4
    least: int = 85
    per: int = 100
    local_heavy: int = 3
    known_heavy: int = 1 << 20
    meets: int = 8
    few: int = 400_000
    hub_share: int = 2_000
    hub_columns: int = 3

    def needed(self, n: np.ndarray) -> np.ndarray:
        """The smallest overlap with any partner that a set of n can be linked at."""
        return -(-self.least * n // self.per)

    def meetings(self, n: Column) -> Column:
        """How many columns of the first block a set of n shares with each linked partner at least."""
        return F.least(F.lit(self.meets), F.ceil(F.lit(self.least) * n / F.lit(self.per)))


#: Shingles that a task counts before it hands on.
FLUSH = 2_000_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By slice of the column: (from row, to row, distinct shingles ascending by text, bounds)."""
    for i, j, flat, bounds, *_ in _keyed_sets(column, words):
        yield i, j, flat, bounds


def _keyed_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """shingle_sets, and 128 bits that stand for each text's words in their order."""
    data, offsets = raw(column)
    for i, j in slices(offsets):
        s, e, bounds = spans(data, offsets[i : j + 1])
        hashes = word_hashes(data, s, e, lower=True)
        keys = _text_key(hashes, bounds), _text_key(word_hashes(data, s, e, lower=True, seed=1), bounds)
        runs, run_bounds = sequence_hashes(hashes, bounds, words)
        size = np.diff(bounds)
        out: list[np.ndarray] = []
        for k in range(j - i):
            if 0 < size[k] < words:
                # A short text is one shingle, apart from any of another length.
                own, _ = sequence_hashes(hashes[bounds[k] : bounds[k + 1]], np.array([0, size[k]]), int(size[k]), seed=int(size[k]))
            else:
                own = np.unique(runs[run_bounds[k] : run_bounds[k + 1]])
            out.append(own)
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        yield i, j, np.concatenate(out), lengths, *keys


def _text_key(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    place = np.arange(len(hashes), dtype=U64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(U64)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * (mix64(place + U64(1)) | U64(1)), out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _frequent(docs: DataFrame, how: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their rank by count; at most known_heavy of them come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            many = times >= how.local_heavy
            return pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["g", "n"])

        for batch in batches:
            for _, _, flat, _ in shingle_sets(batch.column("_text"), how.words):
                held.append(flat)
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    counts = materialize(docs.select("_text").mapInArrow(lean(count), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "ngram_frequent")
    # From which count on there are at most known_heavy: from the counts' own few values.
    above, least = 0, 1
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).collect():
        above += r["count"]
        if above > how.known_heavy:
            least = r["n"] + 1
            break
    top = counts.where(F.col("n") >= least).toArrow()
    grams = top.column("g").to_numpy().view(U64) if top.num_rows else np.zeros(0, U64)
    times = top.column("n").to_numpy() if top.num_rows else np.zeros(0, np.int64)
    order = np.argsort(grams)
    return grams[order], np.minimum(times[order], 2**31 - 1).astype(np.int32)


def _features(docs: DataFrame, how: Likeness, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(_id, n, k1, k2, first): a document's set size, its words' 128 bits, and its columns of the first block in order."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank = shared.value
        for batch in batches:
            for i, j, flat, bounds, k1, k2 in _keyed_sets(batch.column("_text"), how.words):
                n = np.diff(bounds)
                place = np.zeros(len(flat), np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
                    place = np.where(grams[at] == flat, rank[at], 0)
                # A prefix longer by k holds k more of what linked sets share.
                length = np.where(n > 0, n - how.needed(n) + np.minimum(how.meets, how.needed(n)), 0)
                first = []
                for k in range(j - i):
                    own, p = flat[bounds[k] : bounds[k + 1]], place[bounds[k] : bounds[k + 1]]
                    if p.any():
                        own = own[np.argsort(p, kind="stable")]  # of equal counts, by value
                    first.append(own[: length[k]])
                lengths = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), binary_column(np.concatenate(first), lengths)],
                    names=["_id", "n", "k1", "k2", "first"],
                )

    return docs.mapInArrow(lean(run), "_id long, n long, k1 long, k2 long, first binary")


def _postings(classes: DataFrame) -> DataFrame:
    """(g, id, n, place): one row per class and column of the first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = from_binary(batch.column("first"), U64)
            size = np.diff(bounds)
            row = np.repeat(np.arange(len(size)), size)
            ids, n = batch.column("id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids[row]), pa.array(n[row].astype(np.int32)), pa.array((np.arange(len(flat)) - bounds[row]).astype(np.int32))], names=["g", "id", "n", "place"])

    return classes.select("id", "n", "first").mapInArrow(lean(run), "g long, id long, n int, place int")


def _shared_only(postings: DataFrame) -> DataFrame:
    """Rows of columns that two classes hold at least. Rows come sorted by column; only the last is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last: int | None = None  # the column of the row before the held one
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            g = rows.column("g").to_numpy()
            same = g[1:] == g[:-1]
            keep = np.zeros(len(g), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= last is not None and last == g[0]
            yield rows.slice(0, len(g) - 1).filter(pa.array(keep[:-1]))
            if len(g) > 1:
                last = int(g[-2])
            held = rows.slice(len(g) - 1)
        if held is not None and last == held.column("g")[0].as_py():
            yield held

    return postings.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), postings.schema)


def _can_meet(postings: DataFrame, how: Likeness) -> DataFrame:
    """Rows of classes that hold as many shared columns as a linked partner would meet them in."""
    held = F.count(F.lit(1)).over(W.partitionBy("id"))
    return postings.withColumn("held", held).where(F.col("held") >= how.meetings(F.col("n"))).drop("held")


def _whole_sets(docs: DataFrame, wanted: DataFrame, shared_ids: DataFrame | None, how: Likeness) -> DataFrame:
    """(id, set): whole sets, ascending, of the wanted classes (id, _id, k1, k2), each once; _id: of a document of the class.

    shared_ids (_id): those of several rows, if any. Their rows find their class by their words.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, bounds, *_ in _keyed_sets(batch.column("_text"), how.words):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), binary_column(flat, bounds)], names=["id", "set"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, flat, bounds, k1, k2 in _keyed_sets(batch.column("_text"), how.words):
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(k1), pa.array(k2), binary_column(flat, bounds)], names=["_id", "k1", "k2", "set"])

    def few(df: DataFrame) -> DataFrame:
        # 32 bytes a row; beyond, both sides are shuffled.
        df = materialize(df, "ngram_wanted")
        return F.broadcast(df) if df.count() <= how.few else df

    keys = wanted.select("id", "_id", "k1", "k2")
    if shared_ids is None:
        return docs.join(few(keys.select("id", "_id")), "_id").select("id", "_text").mapInArrow(lean(sets), "id long, set binary")
    one = docs.join(few(keys.join(shared_ids, "_id", "left_anti").select("id", "_id")), "_id").select("id", "_text").mapInArrow(lean(sets), "id long, set binary")
    theirs = keys.join(shared_ids, "_id", "left_semi")
    rows = docs.join(few(theirs.select("_id").distinct()), "_id").mapInArrow(lean(keyed), "_id long, k1 long, k2 long, set binary")
    more = rows.join(theirs, ["_id", "k1", "k2"]).select("id", "set").dropDuplicates(["id"])
    return one.unionByName(more)


def _few(narrow: DataFrame, rows: int, how: Likeness) -> DataFrame:
    """Narrow rows that sets are to meet: broadcast, so that sets stay where they are, or shuffled with them beyond how.few."""
    return F.broadcast(narrow) if rows <= how.few else narrow


def _common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of p are in q; both ascend."""
    if not len(q):
        return np.zeros(len(p), bool)
    return q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p


def _linked(pairs: DataFrame, sets: DataFrame, how: Likeness) -> DataFrame:
    """Those of pairs (a, b) whose whole overlap reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xb = from_binary(batch.column("set_a"), U64)
            y, yb = from_binary(batch.column("set_b"), U64)
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                p, q = x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]]
                if len(p) > len(q):
                    p, q = q, p
                if how.per * len(p) < how.least * len(q):
                    continue
                overlap = int(_common(p, q).sum())
                keep[k] = how.per * overlap >= how.least * (len(p) + len(q) - overlap)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")).join(_few(pairs, pairs.count(), how), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(lean(run), "a long, b long")


def _held_against(chosen: DataFrame, sets: DataFrame, how: Likeness) -> DataFrame:
    """(id, hub, n, nh, linked, r, diff) of those chosen (id, hub) that are half alike at least; diff: the r columns that one of both has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xb = from_binary(batch.column("set"), U64)
            y, yb = from_binary(batch.column("hub_set"), U64)
            n, nh = np.diff(xb), np.diff(yb)
            overlap, diffs = np.zeros(len(n), np.int64), []
            for k in range(len(n)):
                p, q = x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]]
                shared = _common(p, q)
                overlap[k] = shared.sum()
                diffs.append(np.concatenate([p[~shared], q[~_common(q, p)]]))
            union = n + nh - overlap
            r = union - overlap
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hub"), pa.array(n), pa.array(nh), pa.array(how.per * overlap >= how.least * union), pa.array(r), binary_column(np.concatenate(diffs), np.concatenate([[0], np.cumsum(r)]))],
                names=["id", "hub", "n", "nh", "linked", "r", "diff"],
            )
            yield out.filter(pa.array(2 * overlap >= union))

    # A hub that a third of all documents name is copied, so that no task gets them all.
    copies = chosen.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / how.hub_share).cast("int").alias("copies"))
    hubs = sets.select(F.col("id").alias("hub"), F.col("set").alias("hub_set")).join(copies, "hub")
    hubs = hubs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = chosen.join(copies, "hub").withColumn("copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).drop("copies")
    both = sets.join(_few(dealt, chosen.count(), how), "id").join(hubs, ["hub", "copy"]).select("id", "hub", "set", "hub_set")
    return both.mapInArrow(lean(run), "id long, hub long, n long, nh long, linked boolean, r long, diff binary")


def _differences(against: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row for each column in which a document differs from its hub: (e, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = from_binary(batch.column("diff"), U64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            rest = batch.select(list(names)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *rest.columns], names=["e", *names])

    types = {c: t for c, t in against.dtypes}
    return against.select(*names, "diff").mapInArrow(lean(run), ", ".join(["e long", *(f"{c} {types[c]}" for c in names)]))


def _families(against: DataFrame, sets: DataFrame, how: Likeness) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with hubs, also among documents that their hub doesn't link, by hubs of their own; and (id, family) of those linked.

    In each round a document is held against the one that meets most others of its group in its rarest
    shared difference. Those linked are done; the others, and the hubs, go into the next round, until
    one links nothing. So a family of near copies comes together in few rounds, whatever its size.
    """
    alive = materialize(_differences(against.where(~F.col("linked")), ("hub", "id", "n")), "ngram_apart")
    found: DataFrame | None = None
    family: DataFrame | None = None
    while True:
        shared = alive.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
        rows = materialize(alive.join(shared, ["hub", "e"]), "ngram_apart_shared")
        if rows.isEmpty():
            break
        met = rows.groupBy("id").agg(F.sum("holders").alias("met"))
        top = rows.join(met, "id").groupBy("hub", "e").agg(F.max(F.struct("met", "id", "n")).alias("top"))
        rarest = rows.groupBy("id").agg(F.min(F.struct("holders", "e", "hub", "n")).alias("of")).select("id", "of.hub", "of.e", "of.n")
        near = (F.col("top.id") != F.col("id")) & _sizes_fit("n", "top.n", how)
        chosen = materialize(rarest.join(top, ["hub", "e"]).where(near).select("id", F.col("top.id").alias("hub")), "ngram_apart_chosen")
        linked = materialize(_held_against(chosen, sets, how).where("linked").select("id", "hub"), "ngram_apart_linked")
        if linked.isEmpty():
            break
        # A hub meets more than those that choose it, so never all of a family go.
        found = linked if found is None else found.unionByName(linked)
        new = linked.withColumnRenamed("hub", "family")
        if family is not None:
            # A family whose hub is linked now is its hub's.
            new = family.join(new.select(F.col("id").alias("family"), F.col("family").alias("to")), "family", "left").select("id", F.coalesce("to", "family").alias("family")).unionByName(new)
        family = materialize(new, "ngram_family")
        alive = materialize(alive.join(linked.select("id"), "id", "left_anti"), "ngram_apart")
    linked = against.where("linked").select("id", "hub")
    of = linked.select("id", F.col("hub").alias("family"))
    if found is not None:
        linked, of = linked.unionByName(found), of.unionByName(family)
    return linked.select(F.col("id").alias("a"), F.col("hub").alias("b")), of


def _pairs_within(against: DataFrame, family: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): pairs of one hub's group that can be linked, one of which the hub doesn't link, and of different families (id, family).

    With t = least / per, two sets are linked if they differ in at most (1 - t) / (1 + t) of their
    sizes' sum, and they differ in r + r' less twice what their differences share. If the other
    isn't linked to the hub, that is more than (r + (1 - t) / (1 + t) * (nh - n)) / 2 columns, and
    for the one that isn't linked r - n * (1 - t) / t at least: so many columns fewer, less one,
    need be looked at.
    """
    apart, both = how.per - how.least, how.per + how.least
    # Groups that their hub links whole are one component already.
    asked = against.where(~F.col("linked")).select("hub").distinct()
    rows = _differences(against.join(asked, "hub", "left_semi"), ("hub", "id", "n", "nh", "linked", "r"))
    shared = rows.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    rows = rows.join(shared, ["hub", "e"])
    own = W.partitionBy("id", "hub")
    # Columns that nobody else of the group differs in come first.
    rows = rows.withColumn("before", F.row_number().over(own.orderBy("holders", "e")) - 1).withColumn("place", F.col("r") - F.count(F.lit(1)).over(own) + F.col("before"))
    short = F.col("r") - F.floor((both * F.col("r") + apart * (F.col("nh") - F.col("n"))) / (2 * both))
    long = F.col("r") - F.greatest(F.lit(1), F.col("r") - F.floor(apart * F.col("n") / how.least)) + 1
    rows = rows.withColumn("short", F.col("place") < short).withColumn("long", ~F.col("linked") & (F.col("place") < F.greatest(short, long))).where("short or long")
    rows = rows.join(family, "id", "left").withColumn("family", F.coalesce("family", "id"))
    rows = materialize(rows.select("hub", "e", "id", "n", "r", "linked", "place", "before", "short", "long", "family"), "ngram_differences")
    # A column's largest family meets the rest only, never itself.
    of = rows.groupBy("hub", "e", "family").agg(F.count(F.lit(1)).alias("rows"))
    main = of.groupBy("hub", "e").agg(F.max_by("family", F.struct("rows", "family")).alias("main"), F.count(F.lit(1)).alias("families")).where("families > 1").drop("families")
    rows = materialize(rows.join(main, ["hub", "e"]), "ngram_differences_open")
    names = ("id", "n", "r", "linked", "place", "before", "short", "family")
    side = lambda df, s: df.select("hub", "e", *[F.col(c).alias(f"{c}_{s}") for c in names])
    x, y, rest = rows.where("short"), rows.where("long"), F.col("family") != F.col("main")
    met = side(x, "x").join(side(y.where(rest), "y"), ["hub", "e"]).unionByName(side(x.where(rest), "x").join(side(y.where(~rest), "y"), ["hub", "e"]))
    most = F.least("before_x", "before_y") + F.least(F.col("r_x") - F.col("place_x"), F.col("r_y") - F.col("place_y"))
    can_reach = 2 * both * most >= both * (F.col("r_x") + F.col("r_y")) - apart * (F.col("n_x") + F.col("n_y"))
    once = F.when(F.col("linked_x"), True).otherwise(F.col("short_y") & (F.col("id_x") > F.col("id_y")))
    met = met.where((F.col("family_x") != F.col("family_y")) & once & _sizes_fit("n_x", "n_y", how) & can_reach)
    return met.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b"))


def _pairs_across(shared: DataFrame, against: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): pairs of different groups that the product over the first block leaves."""
    rows = shared.join(against.select("id", "hub"), "id", "left").withColumn("grp", F.coalesce("hub", "id")).drop("hub")
    groups = rows.groupBy("g", "grp").agg(F.count(F.lit(1)).alias("rows")).groupBy("g").agg(F.max_by("grp", F.struct("rows", "grp")).alias("main"), F.count(F.lit(1)).alias("groups"))
    rows = materialize(rows.join(groups.where("groups > 1").drop("groups"), "g"), "ngram_open")
    # A column's largest group meets the rest only, never itself.
    names = ("id", "n", "place", "before", "grp")
    x = rows.where("grp <> main").select("g", *[F.col(c).alias(f"{c}_x") for c in names])
    y = rows.select("g", "main", *[F.col(c).alias(f"{c}_y") for c in names])
    # What two classes that meet in this column can share: ahead of it, here, and after it.
    most = F.least("before_x", "before_y") + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    can_reach = (how.per + how.least) * most >= how.least * (F.col("n_x") + F.col("n_y"))
    once = (F.col("grp_y") == F.col("main")) | ((F.col("grp_x") != F.col("grp_y")) & (F.col("id_x") > F.col("id_y")))
    met = x.join(y, "g").where(once & _sizes_fit("n_x", "n_y", how) & can_reach)
    block = met.groupBy(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).agg(F.count(F.lit(1)).alias("overlap"), F.min(F.least("n_x", "n_y")).alias("n"))
    # Overlap so far: linked classes meet so often.
    return block.where(F.col("overlap") >= how.meetings(F.col("n"))).select("a", "b")


def _sizes_fit(a: str, b: str, how: Likeness) -> Column:
    return (F.lit(how.per) * F.least(a, b)) >= (F.lit(how.least) * F.greatest(a, b))


def _joined(rows: DataFrame, how: Likeness) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of rows (_id, _text), classes, and the component (id, component) of each class that links with any other."""
    features = materialize(_features(rows, how, _frequent(rows, how)), "ngram_features")
    usable = features.where("n > 0 and _id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("first").alias("first"))
    # A class has a number of its own, fixed once it is written.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "ngram_classes")
    # Ids of several rows, whose texts may be alike or not: narrow rows.
    key = F.struct("k1", "k2")
    per_id = usable.groupBy("_id").agg(F.count(F.lit(1)).alias("rows"), (F.min(key) != F.max(key)).alias("several")).where("rows > 1")
    per_id = materialize(per_id.select("_id", "several"), "ngram_shared_ids")
    shared_ids = None if per_id.isEmpty() else per_id.select("_id")
    shared = _can_meet(_shared_only(_postings(classes)), how)
    # What that leaves can have lost partners: once more.
    left = shared.groupBy("g").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("g")
    shared = _can_meet(shared.join(left, "g", "left_semi"), how)
    # before: columns of the first block ahead of this one that any other class holds; the rest ahead can't be shared.
    before = F.row_number().over(W.partitionBy("id").orderBy("place")) - 1
    shared = materialize(shared.withColumn("before", before), "ngram_postings")
    # The hub of a column is the class that meets most others over all its columns; a class takes the greatest of its columns' hubs.
    sizes = shared.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    met = materialize(shared.join(sizes, "g").groupBy("id").agg(F.sum("df").alias("met")), "ngram_met")
    hubs = shared.join(met, "id").groupBy("g").agg(F.max(F.struct("met", F.col("id").alias("hub"), F.col("n").alias("nh"))).alias("top"))
    fits = (F.col("top.hub") != F.col("id")) & (2 * F.least("n", "top.nh") >= F.greatest("n", "top.nh"))
    # One that shares only a column or two with its hub is hardly half alike, and stays by itself.
    named = shared.join(hubs, "g").where(fits).groupBy("id", F.col("top.hub").alias("hub")).agg(F.max("top.met").alias("met"), F.count(F.lit(1)).alias("columns"))
    chosen = named.where(F.col("columns") >= how.hub_columns).groupBy("id").agg(F.max(F.struct("met", "hub")).alias("top")).select("id", "top.hub")
    chosen = materialize(chosen, "ngram_chosen")
    keys = classes.select("id", "_id", "k1", "k2")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return materialize(_whole_sets(rows, keys.join(wanted.distinct(), "id", "left_semi"), shared_ids, how), "ngram_sets")

    sets = sets_of(chosen.select(F.explode(F.array("id", "hub")).alias("id")))
    against = materialize(_held_against(chosen, sets, how), "ngram_against")
    links, family = _families(against, sets, how)
    pairs = materialize(_pairs_within(against, family, how).unionByName(_pairs_across(shared, against, how)).distinct(), "ngram_pairs")
    new = _linked(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))), how)
    links = links.unionByName(new)
    if shared_ids is not None:
        # An id that several classes hold is one document of all of them.
        of = usable.join(per_id.where("several"), "_id", "left_semi").select("_id", "k1", "k2").distinct().join(keys.select("k1", "k2", "id"), ["k1", "k2"])
        least = of.groupBy("_id").agg(F.min("id").alias("b"))
        links = links.unionByName(of.join(least, "_id").where("id <> b").select(F.col("id").alias("a"), "b"))
    known = components(materialize(links, "ngram_links")).select(F.col("node").alias("id"), "component")
    return features, classes, known


def jaccard_components(docs: DataFrame, how: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach).

    Words are lower-cased A-Z. A null text, or one without words, has no shingle and no link.
    Rows with the same words in the same order are one class and linked at once; rows that share an id count as one
    document, linked with whatever one of their texts is. A row without an id is linked with nothing, and its component_id is null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    with shuffles_dropped(docs.sparkSession):
        features, classes, known = _joined(rows, how)
    # Of each component the smallest document; classes that link with nothing are their own.
    named = known.join(classes.select("id", "_id"), "id").groupBy("component").agg(F.min("_id").alias("least"))
    placed = classes.select("id", "k1", "k2", "_id").join(known, "id", "left").join(named, "component", "left").select("k1", "k2", F.coalesce("least", "_id").alias("component_id"))
    mine = features.where("n > 0 and _id is not null").join(placed, ["k1", "k2"]).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    # Texts without a word, and rows without an id, meet nobody.
    alone = features.where("n = 0 or _id is null").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"))
    return mine.unionByName(alone)
