"""Near copies in families that are half alike, and rows that repeat: right components, and work in proportion to rows."""

from __future__ import annotations

import random

import pytest

from convoy.llm import ngram_join


def counted(monkeypatch):
    """Rows of the tables that the join writes, by name."""
    found: dict[str, int] = {}
    plain = ngram_join.materialize

    def keep(df, name):
        out = plain(df, name)
        found[name] = found.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", keep)
    return found


def families(r, sizes, apart, words=200):
    """(family, text): copies with a word or two changed; each family differs from the first in `apart` words of its own."""
    vocabulary = [f"w{i}" for i in range(4_000)]
    base = [r.choice(vocabulary) for _ in range(words)]
    out = []
    for f, size in enumerate(sizes):
        own = list(base)
        for at in r.sample(range(words), apart if f else 0):
            own[at] = f"f{f}-{at}"
        for _ in range(size):
            copy = list(own)
            for at in r.sample(range(words), r.randint(0, 2)):
                copy[at] = r.choice(vocabulary)
            out.append((f, " ".join(copy)))
    r.shuffle(out)
    return out


def linked_by_brute_force(rows, how):
    """component by id, over shingle sets."""
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + how.words]) for k in range(len(w) - how.words + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if find(i) != find(j):
                both = len(sets[i] & sets[j])
                if how.per * both >= how.least * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("sizes", "apart"), [((120, 70, 50), 24), ((60, 40, 30, 30), 6)])
def test_families_half_alike(spark, monkeypatch, sizes, apart):
    told = families(random.Random(sum(sizes) + apart), sizes, apart)
    rows = [(i, t) for i, (_, t) in enumerate(told)]
    found = counted(monkeypatch)
    how = ngram_join.Likeness()
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
    assert got == linked_by_brute_force(rows, how)
    # At six words copies of two families are about as alike as the bound, and many pairs must be looked at.
    assert found.get("ngram_pairs", 0) < (2 if apart == 24 else 10) * len(rows), found


def test_pairs_grow_with_rows_not_with_their_square(spark, monkeypatch):
    told = families(random.Random(1), (700, 300, 200), 24)
    rows = [(i, t) for i, (_, t) in enumerate(told)]
    found = counted(monkeypatch)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, (f, _) in enumerate(told):
        first.setdefault(f, i)
    assert got == {i: first[f] for i, (f, _) in enumerate(told)}
    assert found.get("ngram_pairs", 0) < len(rows), found


def test_rows_that_repeat_are_one_class(spark, monkeypatch):
    told = families(random.Random(2), (60, 30), 24)
    rows = [(i, t) for i, (_, t) in enumerate(told)]
    found = counted(monkeypatch)
    once = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    work, sets = found.get("ngram_against"), found.get("ngram_sets")
    found.clear()
    got = ngram_join.jaccard_components(spark.createDataFrame(rows * 30, "doc_id long, text string")).collect()
    assert len(got) == 30 * len(rows) and {r.doc_id: r.component_id for r in got} == once
    assert (found.get("ngram_against"), found.get("ngram_sets")) == (work, sets)


def test_an_id_of_many_texts_is_one_document(spark):
    r = random.Random(3)
    text = lambda k: " ".join(f"t{k}-{i}" for i in range(30))
    many = [(7, text(k)) for k in range(40)]
    rows = [*many, (3, text(11) + " end"), (9, text(12)), (50, text(99)), (60, " ".join(r.choice("ab") for _ in range(3)))]
    got = {(x.doc_id, x.component_id) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (50, 50), (60, 60)}
