"""Similar renames, broken rewrites and the greedy choice against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convoy.operators import snapshots

OPS = "repo string, op string, path string, old_path string, blob string, old_blob string"


def lines(text):
    return Counter(text.split("\n"))


def weigh(counts):
    return sum(n * (len(t) + 1) for t, n in counts.items())


def score(a, b):
    return weigh(lines(a) & lines(b)) / max(weigh(lines(a)), weigh(lines(b)))


def brute(ops, texts, threshold=0.5, least=400):
    """Plain rename detection of one repository: ops are (op, path, blob, old_blob)."""
    out, gone, new, broken = [], {}, {}, set()
    for op, path, blob, old in ops:
        if op == "M":
            a, b = lines(texts[old]), lines(texts[blob])
            kept, removed, added = weigh(a & b), weigh(a - b), weigh(b - a)
            heavier = max(weigh(a), weigh(b))
            mere = removed > 0.5 * weigh(a) and added * 20 < removed and added * 20 < kept
            if heavier >= least and removed + added >= 0.5 * heavier and not mere:
                broken.add(path)
                gone[path], new[path] = old, blob
            else:
                out.append(("M", path, None))
        elif op == "D":
            gone[path] = old
        else:
            new[path] = blob
    taken = {}
    for b in sorted(set(gone.values())):
        for old, path in zip(sorted(p for p in gone if gone[p] == b), sorted(p for p in new if new[p] == b), strict=False):
            taken[path] = old
    ranked = sorted((-score(texts[gone[o]], texts[new[p]]), o, p) for o in gone for p in new if o != p and o not in taken.values() and p not in taken)
    for s, o, p in ranked:
        if -s >= threshold and o not in taken.values() and p not in taken:
            taken[p] = o
    used = set(taken.values())
    out += [("R", p, o) for p, o in taken.items()]
    for p in set(gone) | set(new):
        d, a = p in gone and p not in used, p in new and p not in taken
        if p in broken:
            out += [("M", p, None)] if d and a else [("A", p, None)] if a else []
        else:
            out += [("D", p, None)] * d + [("A", p, None)] * a
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_renames_equal_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"line number {i} " + "x" * r.randint(0, 30) for i in range(40)]
    rows, texts, want = [], {}, {}
    for repo in ("r", "q"):
        bodies = [[*r.choices(words, k=r.randint(3, 30)), "", "}", "}"] for _ in range(8)]
        ops = []
        for i in range(40):
            body = list(r.choice(bodies))
            for _ in range(r.randint(0, len(body))):
                body[r.randrange(len(body))] = r.choice(words)
            other = list(r.choice(bodies))
            old, new = (f"b{seed}{repo}{i}{side}" for side in "on")
            texts[old], texts[new] = "\n".join(body), "\n".join(other if r.random() < 0.6 else body[: r.randint(0, len(body))] + ["end"])
            op = r.choice("DAM")
            ops.append((op, f"p{i:02}", None if op == "D" else new, None if op == "A" else old))
        # Equal texts have one blob.
        first = {}
        name = {b: first.setdefault(t, b) for b, t in sorted(texts.items())}
        ops = [(o, p, name.get(b), name.get(d)) for o, p, b, d in ops if not (o == "M" and name.get(b) == name.get(d))]
        rows += [(repo, o, p, None, b, d) for o, p, b, d in ops]
        want[repo] = brute(ops, texts)
    contents = spark.createDataFrame(list(texts.items()), "blob string, content string")
    got = snapshots.detect_similar_renames(spark.createDataFrame(rows, OPS), contents).collect()
    for repo in want:
        assert sorted(((x.op, x.path, x.old_path) for x in got if x.repo == repo), key=repr) == want[repo]
    assert any(o == "R" for v in want.values() for o, _, _ in v)


def test_swapped_files_are_two_renames(spark):
    a, b = ("\n".join(f"{x} line {i} of a long enough file" for i in range(20)) for x in "ab")
    rows = [("r", "M", "a.md", None, "B", "A"), ("r", "M", "b.md", None, "A", "B")]
    contents = spark.createDataFrame([("A", a), ("B", b)], "blob string, content string")
    got = {(x.op, x.path, x.old_path) for x in snapshots.detect_similar_renames(spark.createDataFrame(rows, OPS), contents).collect()}
    assert got == {("R", "a.md", "b.md"), ("R", "b.md", "a.md")}
    whole = {(x.op, x.path) for x in snapshots.detect_similar_renames(spark.createDataFrame(rows, OPS), contents, break_rewrites=False).collect()}
    assert whole == {("M", "a.md"), ("M", "b.md")}


def test_a_line_of_all_files_forms_no_pair(spark):
    """A header and a brace in every file: prefixes hold own lines only, so files that share nothing else never meet."""
    n = 60
    text = lambda i: "\n".join(["# the same header in all files", "}", *(f"own line {i}-{k}" for k in range(6))])
    files = [("r", "D" if i % 2 else "A", f"p{i}", f"b{i}") for i in range(n)]
    lined = snapshots._lined(spark.createDataFrame(files, "repo string, side string, path string, blob string"), spark.createDataFrame([(f"b{i}", text(i)) for i in range(n)], "blob string, content string"))
    first = snapshots._prefixes(lined, 0.5)
    met = first.where("side = 'D'").alias("d").join(first.where("side = 'A'").alias("a"), ["repo", "line", "width"]).count()
    assert met == 0 and first.groupBy("repo", "side", "path").count().count() == n


def test_a_text_is_measured_once_and_not_for_each_line(spark):
    files = spark.createDataFrame([("r", "D", "p", "b")], "repo string, side string, path string, blob string")
    lined = snapshots._lined(files, spark.createDataFrame([("b", "one\r\ntwo\ntwo")], "blob string, content string"))
    assert sorted((r.total, r.width, r.n) for r in lined.collect()) == [(12, 3, 1), (12, 3, 2)]
    above = lined._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "Aggregate" in above and "content" not in above and "regexp_replace" not in above


def test_interleaved_scores_take_few_rounds(spark, monkeypatch):
    """A chain in which each pair waits for the one before: settled at once, or in rounds where pairs are many."""
    pairs = [("r", f"o{i:02}", f"n{i + k:02}", 1.0 - (2 * i + k) / 100) for i in range(20) for k in (0, 1)]
    scored = spark.createDataFrame(pairs, "repo string, old_path string, path string, score double")
    written = []
    plain = snapshots.materialize
    monkeypatch.setattr(snapshots, "materialize", lambda df, name: written.append(name) or plain(df, name))
    want = {(f"o{i:02}", f"n{i:02}") for i in range(20)}
    assert {(r.old_path, r.path) for r in snapshots.greedy_pairs(scored).collect()} == want
    assert len(written) <= 3
    assert {(r.old_path, r.path) for r in snapshots.greedy_pairs(scored, most=10).collect()} == want


def test_no_operations(spark):
    none = spark.createDataFrame([], OPS)
    assert snapshots.detect_similar_renames(none, spark.createDataFrame([], "blob string, content string")).withColumn("x", F.lit(1)).count() == 0
