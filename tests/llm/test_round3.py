"""Suffix dedup, hard negatives and centroid clustering against brute force, on odd rows and at size."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import centroids, negatives, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, doc string, key string, places string"
VECTORS = "vec_id long, embedding array<double>, label int, id long, grp string"


def brute_repeats(rows, window):
    """(bytes, removed, spans, digest) by (id, text): windows in order of id, then of the text's hash."""
    last = 1 << 63
    texts = {(last if i is None else i, t or "") for i, t in rows}
    seen, out = set(), {}
    for i, t in sorted(texts):
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - window + 1):
            piece = data[k : k + window]
            if piece in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(piece)
        spans = len([k for k in range(len(data)) if gone[k] and (not k or not gone[k - 1])])
        out[i, t] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def cut(spark, rows, how):
    df = spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], DOCS)
    got = suffix_dedup.remove_repeats(df, how).collect()
    assert len(got) == len(rows)
    return [((1 << 63 if r["doc_id"] is None else r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got]


def agrees(spark, rows, how):
    want = brute_repeats(rows, how.window)
    expected = sorted(((1 << 63 if i is None else i), want[(1 << 63 if i is None else i), t or ""]) for i, t in rows)
    assert sorted(cut(spark, rows, how)) == expected


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.mark.parametrize("how", [suffix_dedup.Suffixes(), suffix_dedup.Suffixes(flush=300, stretch=400), suffix_dedup.Suffixes(window=40, gram=16, parts=(1,), flush=500), suffix_dedup.Suffixes(parts=(1, 3, 9), flush=2_000)])
def test_suffix_dedup_equals_brute_force(spark, how):
    r = random.Random(how.flush)
    words = [f"w{i}é"[: r.randint(2, 5)] for i in range(30)]
    passages = [prose(r, 40, words) for _ in range(4)]
    rows = []
    for i in range(60):
        text = prose(r, r.randint(0, 60), words)
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(text))
            a = r.randint(0, 30)
            text = text[:at] + p[a : a + r.randint(60, 160)] + text[at:]
        rows.append((i * 7 % 61, text))
    rows += [(100 + k, "ab" * 200) for k in range(3)] + [(200, "x" * 1_000), (201, None), (202, ""), (203, "é" * 99)]
    agrees(spark, rows, how)


def test_suffix_dedup_on_odd_rows(spark):
    """Repeated rows are one document; an id that other texts share; null ids last; a text over many stretches."""
    r = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    long = prose(r, 9_000, words)
    a = prose(r, 60, words)
    # Of one id only one text can meet a copy here, so the order of hashes is told by neither side.
    rows = [(1, a), (1, a), (2, a + " end"), (3, long), (4, "head " + long[20_000:40_000]), (None, long[:500]), (None, long[:500]), (9, None), (9, "short"), (5, "")]
    agrees(spark, rows, suffix_dedup.Suffixes(stretch=1 << 14))
    assert cut(spark, [(1, "a" * 300)], suffix_dedup.Suffixes())[0][1][:3] == (300, 299, 1)


def test_suffix_dedup_ids_that_repeat_share_one_order(spark):
    """Two texts of one id hold the same passage: one of them loses it, whichever has the smaller hash."""
    p = prose(random.Random(1), 50, [f"w{i}" for i in range(500)])
    got = cut(spark, [(1, p + " one"), (1, p + " two"), (0, "nothing")], suffix_dedup.Suffixes())
    assert sorted(v[1] for _, v in got) == [0, 0, len(p) + 1]


def test_suffix_dedup_gives_bytes_and_ranges_and_takes_no_rows(spark):
    p = "0123456789" * 9 + "abcdefghijé"
    df = spark.createDataFrame([(1, p), (2, "<" + p + ">")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, keep_bytes=True).collect()}
    assert bytes(got[1]["kept"]) == p.encode() and not got[1]["removed"]
    assert bytes(got[2]["kept"]) == b"<>" and [tuple(x) for x in got[2]["removed"]] == [(1, 1 + len(p.encode()))]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_a_gram_that_a_task_finds_divided_sends_a_mark_only():
    """Before the exchange: what repeats is settled, what is first of a divided bucket is open, and a bucket of one kind sends one row."""
    h = np.array([1, 1, 1, 2, 2, 3], np.int64)
    c = np.array([5, 5, 6, 7, 7, 8], np.int64)
    doc, zero = np.array([3, 1, 2, 4, 5, 6], np.int64), np.zeros(6, np.int64)
    rows = [r for b in suffix_dedup._settled(h, c, doc, zero, zero, None, False) for r in b.to_pylist()]
    kinds = lambda k: sorted(r["doc"] for r in rows if r["kind"] == k)
    assert kinds(suffix_dedup._REPEATED) == [3, 5] and kinds(suffix_dedup._OPEN) == [1, 2] and kinds(suffix_dedup._SUFFIX) == [4, 6]
    assert [r["h"] for r in rows if r["kind"] == suffix_dedup._MARK] == [1]


def brute_mine(rows, how):
    kept = [(i, lab, np.floor(how.scale * np.array(v, float)).astype(np.int64)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, lab, v in kept:
        if i % how.every or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        scored = [(int(v @ w), j, other) for j, other, w in kept if len(w) == len(v)]
        best = sorted(((-s, j) for s, j, other in scored if other == lab and j != i))[: how.positives]
        for p, j in best:
            p = -p
            found = sorted((-s, k) for s, k, other in scored if other != lab and how.low * p <= 100 * s <= how.high * p)[: how.negatives]
            out += [(i, j, rank, k, p, -s) for rank, (s, k) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, how):
    df = spark.createDataFrame([(i, v, lab, 7, "z") for i, v, lab in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.mine(df, how).collect())


@pytest.mark.parametrize("how", [negatives.Mining(every=5), negatives.Mining(every=3, block_rows=16, anchor_rows=4, chunk=2, positives=2), negatives.Mining(every=2, block_rows=8, anchor_rows=64, low=90, high=100)])
def test_mining_equals_brute_force(spark, how):
    r = np.random.default_rng(how.every)
    centres = r.normal(size=(6, 12))
    rows = []
    for i in range(150):
        label = int(r.integers(0, 4)) if i % 3 else 0
        v = centres[label] + 0.6 * r.normal(size=12)
        rows.append((i, [float(x) for x in v], label))
    rows += [(200 + i, [1.0, 2.0, 3.0], i % 2) for i in range(12)]  # ties, of another dimension
    rows += [(30, rows[30][1], rows[30][2]), (31, rows[31][1], rows[31][2]), (30, rows[32][1], 9)]
    rows += [(None, rows[0][1], 1), (300, None, 1), (301, rows[0][1], None), (302, [float("nan")] * 12, 1), (303, [None] * 12, 1), (304, [0.0] * 12, 1), (60, [], 1)]
    assert mined(spark, rows, how) == brute_mine(rows, how)


def test_mining_takes_no_rows_and_rows_alike(spark):
    how = negatives.Mining(every=50, block_rows=32, anchor_rows=8)
    assert mined(spark, [], how) == []
    # A thousand rows alike fill many blocks of their own, not one.
    rows = [(1, [1.0, 0.0], 1)] * 1_000 + [(50, [1.0, 0.0], 1), (3, [0.75, 1.0], 2)]
    df = spark.createDataFrame([(i, v, lab, 0, "") for i, v, lab in rows], VECTORS)
    dealt = negatives._rows(df, "vec_id", "embedding", "label", how).withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(32)))
    assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 80
    assert mined(spark, rows, how) == brute_mine(rows, how)


def test_bounds_hold_and_spare_scores():
    """On anchors that lie near each other, most candidates are not scored again."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(2_000, 16))).astype(np.int64)
    anchors = np.floor(256 * (r.normal(size=16) + 0.02 * r.normal(size=(40, 16)))).astype(np.int64)
    order, parent, edge = negatives.spanning_tree(anchors.astype(float))
    walk = negatives.Walk(anchors[order], parent, edge, x)
    labels = np.zeros(2_000, np.int64)
    windows = [[(0, 900_000, 1_500_000)] for _ in order]
    got = {f[0]: f for f in negatives.best_negatives(walk, np.arange(2_000), labels, order, np.ones(40, np.int64), windows, 3)}
    for k, i in enumerate(order):
        score = x @ anchors[i]
        inside = np.flatnonzero((score >= 900_000) & (score <= 1_500_000))
        best = inside[np.lexsort((inside, -score[inside]))][:3]
        assert (len(best) == 0 and k not in got) or got[k][2].tolist() == best.tolist()
    assert walk.scored < 0.4 * 40 * 2_000
    assert not walk.ranges


def test_products_beyond_64_bits_raise():
    big = np.full((1, 2), 1 << 32, np.int64)
    with pytest.raises(OverflowError):
        negatives.Walk(big, np.array([-1]), np.zeros(1), big)


def brute_clusters(rows, how):
    kept = [(i, [int(np.floor(how.scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == how.dim and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{how.salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[: how.clusters]
    cs = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))
    for _ in range(how.rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == k]) else c for k, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept] if cs else []
    total = sum(d for _, d, _ in last)
    return sorted(((i, c, d, sum(x[1] for x in last if x[2] == c), total, hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in last), key=repr)


@pytest.mark.parametrize("how", [centroids.Clustering(dim=6), centroids.Clustering(dim=6, clusters=25, rounds=4, batch=7), centroids.Clustering(dim=6, clusters=1, rounds=2), centroids.Clustering(dim=6, clusters=500, rounds=2, scale=4)])
def test_clusters_equal_brute_force(spark, how):
    r = np.random.default_rng(how.clusters)
    rows = [(i, [float(x) for x in r.normal(size=6) + (i % 5)]) for i in range(120)]
    rows += [(500 + i, [float(i % 2)] * 6) for i in range(10)] + [rows[3], (None, rows[4][1])]
    rows += [(600, None), (601, [1.0] * 5), (602, [float("inf")] + [0.0] * 5), (603, [None] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1, "g") for i, v in rows], VECTORS)
    got = sorted((tuple(x) for x in centroids.cluster(df, how).collect()), key=repr)
    assert got == brute_clusters(rows, how)


def test_clusters_of_no_rows_and_bounds(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 0, 0, "")], VECTORS)
    assert centroids.cluster(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(df).collect()
    with pytest.raises(ValueError, match="MB"):
        centroids.cluster(df, centroids.Clustering(clusters=100_000))


def test_orchard_walk_spares_distances():
    r = np.random.default_rng(2)
    c = r.integers(0, 10_000, size=(64, 2))
    x = r.integers(0, 10_000, size=(3_000, 2)).astype(np.int64)
    lists = centroids.Lists(c)
    own, best, measured = centroids.nearest(x, lists)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert np.array_equal(own, d.argmin(axis=1)) and np.array_equal(best, d.min(axis=1))
    assert measured < 0.5 * 64 * 3_000


def test_queries_agree_with_brute_force(spark):
    rows = [(r["vec_id"], list(r["embedding"]), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect())
    assert got == brute_mine(rows, negatives.Mining())
    found = queries.op11_suffix_dedup(spark, SF).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k[0]: v for k, v in brute_repeats(docs, 100).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == want


def test_frequent_words_are_answered_where_they_are_read(spark):
    """A word that is half of all tokens, and its pairs, stay with their blocks; scores are the same as when they travel."""
    from convoy.llm import lm

    r = random.Random(4)
    rows = [(i, " ".join(w for _ in range(r.randint(0, 40)) for w in ("the", f"w{r.randint(0, 200)}"))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    got, plain = ({x.doc_id: tuple(x) for x in lm.score_documents(df, held, order).collect()} for order in (lm.Order(), lm.Order(hot=1)))
    assert got.keys() == plain.keys()
    for i in got:
        assert got[i][:5] == plain[i][:5] and got[i][5:] == pytest.approx(plain[i][5:], abs=1e-9)
    counted = spark.createDataFrame([(5, 600, 1.0, 2.0), (9, 400, 3.0, 4.0), (7, 1, 0.0, 0.0)], "k long, c long, x double, y double")
    k, x, y = lm.hot_weights(counted, 5_000, lm.Order())
    assert (k.tolist(), x.tolist(), y.tolist()) == ([5, 9], [1.0, 3.0], [2.0, 4.0])


def test_settled_places_are_one_file_to_a_bucket(spark):
    """By their keys each would be written to a bucket of its own: a file for nearly every row."""
    from convoy.llm import substring_dedup
    from convoy.llm.shared import fresh_path

    rows = spark.createDataFrame([(i, " ".join(f"w{i % 40}x{j}" for j in range(30))) for i in range(80)], "key long, text string")
    index = substring_dedup.FingerprintIndex(spark, substring_dedup.Windows(window=12, gram=5, buckets=8), fresh_path(spark, "own_index"))
    assert {r.key for r in index.add(rows).collect()} == set(range(80))
    root = Path(index.path.removeprefix("file:"))
    assert 0 < len(list(root.glob("run-*/kind=1/*.parquet"))) <= 8
    index.close()
