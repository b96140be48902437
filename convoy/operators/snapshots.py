"""Differences of file snapshots and their replay. Snapshots are rows (repo, path, blob, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.functions.rules import Rules, is_delivered, matches
from convoy.functions.text import eol_normalize
from convoy.sources.shared import materialize



def _kind(mode: Column) -> Column:
    return F.substring(F.coalesce(mode, F.lit("100644")), 1, 3)


def snapshot_diff(left: DataFrame, right: DataFrame, rules: Rules) -> DataFrame:
    """(repo, op, path, old_path, blob, old_blob): A, M, D and T from left to right, of managed and not private paths.

    T is a change of the file's kind; a changed permission alone is M. With an empty left
    side every path is A. Only names and hashes are shuffled, never contents.
    """

    def side(df: DataFrame, s: str) -> DataFrame:
        mode = F.col("mode") if "mode" in df.columns else F.lit(None).cast("string")
        kept = df.where(is_delivered(F.col("path"), rules))
        return kept.select("repo", "path", F.col("blob").alias(f"blob_{s}"), mode.alias(f"mode_{s}"), F.lit(True).alias(f"in_{s}"))

    both = side(left, "l").join(side(right, "r"), ["repo", "path"], "full")
    other_mode = ~F.col("mode_l").eqNullSafe(F.col("mode_r"))
    op = (
        F.when(F.col("in_l").isNull(), "A")
        .when(F.col("in_r").isNull(), "D")
        .when(_kind(F.col("mode_l")) != _kind(F.col("mode_r")), "T")
        .when((F.col("blob_l") != F.col("blob_r")) | other_mode, "M")
    )
    found = both.withColumn("op", op).where("op is not null")
    return found.select("repo", "op", "path", F.lit(None).cast("string").alias("old_path"), F.col("blob_r").alias("blob"), F.col("blob_l").alias("old_blob"))


def _paired(ops: DataFrame, pairs: DataFrame) -> DataFrame:
    """ops with each pair (repo, old_path, path) as one R instead of a D and an A."""
    moved = pairs.join(ops.where("op = 'A'").select("repo", "path", "blob"), ["repo", "path"])
    rest = ops.join(pairs.select("repo", F.col("path").alias("path"), F.lit("A").alias("op")), ["repo", "path", "op"], "left_anti")
    rest = rest.join(pairs.select("repo", F.col("old_path").alias("path"), F.lit("D").alias("op")), ["repo", "path", "op"], "left_anti")
    old = ops.where("op = 'D'").select("repo", F.col("path").alias("old_path"), "old_blob")
    renames = moved.join(old, ["repo", "old_path"]).select("repo", F.lit("R").alias("op"), "path", "old_path", "blob", "old_blob")
    return rest.select("repo", "op", "path", "old_path", "blob", "old_blob").unionByName(renames)


def exact_renames(ops: DataFrame) -> DataFrame:
    """(repo, old_path, path): deleted and added paths of one blob, paired in order of their names."""
    by = lambda path: W.partitionBy("repo", "b").orderBy(path)
    gone = ops.where("op = 'D'").select("repo", F.col("old_blob").alias("b"), F.col("path").alias("old_path")).withColumn("k", F.row_number().over(by("old_path")))
    new = ops.where("op = 'A'").select("repo", F.col("blob").alias("b"), "path").withColumn("k", F.row_number().over(by("path")))
    return gone.join(new, ["repo", "b", "k"]).select("repo", "old_path", "path")


def detect_renames(ops: DataFrame) -> DataFrame:
    """ops with exact renames paired to R. The operations are few beside the files, and are written once for their several uses."""
    ops = materialize(ops, "ops")
    return _paired(ops, exact_renames(ops))


def _lined(files: DataFrame, contents: DataFrame) -> DataFrame:
    """files (repo, side, path, blob) as lines: (repo, side, path, total, line, width, n). A line is its hash and width; it weighs width + 1, and a file the total of its lines."""
    # Only contents that are asked for go on, each once.
    texts = contents.select("blob", "content").join(files.select("blob").distinct(), "blob", "left_semi").dropDuplicates(["blob"])
    text = eol_normalize(F.col("content"))
    whole = files.join(texts, "blob").select("repo", "side", "path", text.alias("text"))
    # The total is taken before lines part; else it would go over the whole text again for each line.
    whole = whole.select("repo", "side", "path", (F.length("text") + 1).cast("long").alias("total"), F.split("text", "\n").alias("lines"))
    each = whole.select("repo", "side", "path", "total", F.explode("lines").alias("text"))
    return each.groupBy("repo", "side", "path", "total", F.xxhash64("text").alias("line"), F.length("text").alias("width")).agg(F.count(F.lit(1)).alias("n"))


def _prefixes(lined: DataFrame, threshold: float) -> DataFrame:
    """Of each file the rarest lines, so many that what is left weighs less than the threshold's share of it.

    Two files that share that share of the heavier one share a line of both prefixes: the rarest
    of those they share. A line of all files is in a prefix only where a file has hardly another.
    """
    # Counted before they meet: a line that all files have is one row here.
    common = lined.groupBy("repo", "line", "width").agg(F.count(F.lit(1)).alias("files"))
    weight = F.col("n") * (F.col("width") + 1)
    before = W.partitionBy("repo", "side", "path").orderBy("files", "line", "width").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(weight).over(before), F.lit(0))
    placed = lined.join(common, ["repo", "line", "width"]).withColumn("ahead", ahead)
    return placed.where(F.col("total") - F.col("ahead") >= threshold * F.col("total") - 1e-6)


def line_similarity(ops: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """(repo, old_path, path, score): shared lines' weight over the heavier side's, for pairs of D and A of different paths that reach threshold.

    contents: (blob, content). Pairs are found by rare lines within a repository and then counted over all lines.
    """
    old = ops.where("op = 'D'").select("repo", F.lit("D").alias("side"), "path", F.col("old_blob").alias("blob"))
    new = ops.where("op = 'A'").select("repo", F.lit("A").alias("side"), "path", "blob")
    lined = materialize(_lined(old.unionByName(new), contents), "lined")
    first = _prefixes(lined, threshold)
    own = lambda df, side, name: df.where(F.col("side") == side).select("repo", "line", "width", F.col("path").alias(name), F.col("total").alias(f"{name}_total"), F.col("n").alias(f"{name}_n"))
    met = own(first, "D", "old_path").join(own(first, "A", "path"), ["repo", "line", "width"])
    # A pair that can't reach the threshold by size alone is not formed.
    heavier = F.greatest("old_path_total", "path_total")
    fits = (F.least("old_path_total", "path_total") >= threshold * heavier) & (F.col("old_path") != F.col("path"))
    pairs = met.where(fits).select("repo", "old_path", "path", heavier.alias("heavier")).distinct()
    both = pairs.join(own(lined, "D", "old_path"), ["repo", "old_path"]).join(own(lined, "A", "path"), ["repo", "path", "line", "width"])
    shared = both.groupBy("repo", "old_path", "path", "heavier").agg(F.sum(F.least("old_path_n", "path_n") * (F.col("width") + 1)).alias("shared"))
    return shared.withColumn("score", F.col("shared") / F.col("heavier")).where(F.col("score") >= threshold).select("repo", "old_path", "path", "score")


def rewritten(ops: DataFrame, contents: DataFrame, share: float = 0.5, least: int = 400) -> DataFrame:
    """(repo, path) of M whose content was rewritten: of the heavier side, at least `share` is gone or new, and it isn't mere removal.

    Files of fewer than `least` characters on both sides are too small to tell. contents: (blob, content).
    """
    changed = ops.where("op = 'M'")
    sides = changed.select("repo", F.explode(F.array(F.struct(F.lit("D").alias("side"), F.col("old_blob").alias("blob")), F.struct(F.lit("A").alias("side"), "blob"))).alias("s"), "path")
    lined = _lined(sides.select("repo", "s.side", "path", "s.blob"), contents)
    # Lines of one path meet, nothing else does.
    at = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    line = lined.groupBy("repo", "path", "line", "width").agg(at("D").alias("d"), at("A").alias("a"))
    weigh = lambda n: F.sum(n * (F.col("width") + 1))
    told = line.groupBy("repo", "path").agg(weigh(F.greatest(F.col("d") - F.col("a"), F.lit(0))).alias("gone"), weigh(F.greatest(F.col("a") - F.col("d"), F.lit(0))).alias("new"), weigh(F.least("a", "d")).alias("kept"))
    heavier = F.col("kept") + F.greatest("gone", "new")
    enough = (heavier >= least) & (F.col("gone") + F.col("new") >= share * heavier)
    only_removed = (F.col("gone") > share * (F.col("kept") + F.col("gone"))) & (F.col("new") * 20 < F.col("gone")) & (F.col("new") * 20 < F.col("kept"))
    return told.where(enough & ~only_removed).select("repo", "path")


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Best score first, each path once. Pairs of one repository that are few."""
    old, new, taken = set(), set(), []
    ranked = pairs.sort_values(["score", "old_path", "path"], ascending=[False, True, True])
    for row in ranked.itertuples(index=False):
        if row.old_path not in old and row.path not in new:
            old.add(row.old_path)
            new.add(row.path)
            taken.append((row.repo, row.old_path, row.path))
    return pd.DataFrame(taken, columns=["repo", "old_path", "path"])


def greedy_pairs(scored: DataFrame, most: int = 100_000) -> DataFrame:
    """(repo, old_path, path): best score first, each path once.

    A repository with at most `most` pairs left is settled in one go. Of the others a round takes the
    pairs that are the best open ones of both their paths, which the greedy order would take too, and drops all others
    of those paths, until they have so few. Rounds are written to the shared folder.
    """
    rank = F.struct((-F.col("score")).alias("s"), "old_path", "path").alias("rank")
    left = materialize(scored.select("repo", "old_path", "path", "score"), "scored")
    taken = left.limit(0).select("repo", "old_path", "path")
    while not left.isEmpty():
        many = left.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("repo")
        few = left.join(many, "repo", "left_anti")
        taken = taken.unionByName(materialize(few.groupBy("repo").applyInPandas(_greedy, "repo string, old_path string, path string"), "settled_pairs"))
        left = materialize(left.join(many, "repo", "left_semi"), "scored")
        if left.isEmpty():
            break
        of_old = left.groupBy("repo", "old_path").agg(F.min(rank).alias("rank")).select("repo", "rank")
        of_new = left.groupBy("repo", "path").agg(F.min(rank).alias("rank")).select("repo", "rank")
        best = materialize(of_old.join(of_new, ["repo", "rank"]).select("repo", "rank.old_path", "rank.path"), "best_pairs")
        taken = taken.unionByName(best)
        left = left.join(best.select("repo", "old_path"), ["repo", "old_path"], "left_anti")
        left = materialize(left.join(best.select("repo", "path"), ["repo", "path"], "left_anti"), "scored")
    return taken


def detect_similar_renames(ops: DataFrame, contents: DataFrame, threshold: float = 0.5, *, break_rewrites: bool = True) -> DataFrame:
    """ops with exact renames, then similar ones, paired to R.

    A rewritten M is first divided into a D of what it held and an A of what it holds now, so its old
    content can be found elsewhere and its new one can come from elsewhere. Halves that both stay unpaired are
    an M again; where only the new half came from elsewhere nothing is deleted, as the path stays.
    """
    ops = materialize(ops.select("repo", "op", "path", "old_path", "blob", "old_blob"), "ops")
    if not break_rewrites:
        exact = materialize(_paired(ops, exact_renames(ops)), "exact_ops")
        return _paired(exact, greedy_pairs(line_similarity(exact, contents, threshold)))
    halves = materialize(rewritten(ops, contents).withColumn("op", F.lit("M")), "rewritten")
    of = ops.join(halves, ["repo", "path", "op"], "left_semi")
    nothing = F.lit(None).cast("string")
    gone = of.withColumns({"op": F.lit("D"), "blob": nothing})
    new = of.withColumns({"op": F.lit("A"), "old_blob": nothing})
    divided = materialize(ops.join(halves, ["repo", "path", "op"], "left_anti").unionByName(gone).unionByName(new), "divided_ops")
    exact = materialize(_paired(divided, exact_renames(divided)), "exact_ops")
    paired = _paired(exact, greedy_pairs(line_similarity(exact, contents, threshold)))
    # Halves that are left.
    marked = paired.join(halves.select("repo", "path", F.lit(True).alias("half")), ["repo", "path"], "left")
    is_half = F.coalesce("half", F.lit(False)) & F.col("op").isin("A", "D")
    rest = marked.where(~is_half).drop("half")
    sides = marked.where(is_half).groupBy("repo", "path").agg(F.max("blob").alias("blob"), F.max("old_blob").alias("old_blob"))
    op = F.when(F.col("blob").isNull(), None).when(F.col("old_blob").isNull(), "A").otherwise("M")
    again = sides.withColumn("op", op).where("op is not null").withColumn("old_path", nothing)
    return rest.unionByName(again.select("repo", "op", "path", "old_path", "blob", "old_blob").select(*rest.columns))


def without_owned(ops: DataFrame, rules: Rules) -> DataFrame:
    """ops that touch no consumer-owned, merged or private path on either side."""

    def owned(path: str) -> Column:
        c = F.col(path)
        return matches(c, rules, "always_local") | matches(c, rules, "merge") | matches(c, rules, "private")

    return ops.where(~owned("path") & (F.col("old_path").isNull() | ~owned("old_path")))


def replay_ops(files: DataFrame, ops: DataFrame, tip: DataFrame) -> DataFrame:
    """(repo, path, blob) after ops: A, M, T, R and C write the tip's content, D removes, R removes its source, C keeps it."""
    removed = ops.where("op in ('D', 'R')").select("repo", F.when(F.col("op") == "D", F.col("path")).otherwise(F.col("old_path")).alias("path"))
    written = ops.where("op in ('A', 'M', 'T', 'R', 'C')").select("repo", "path").distinct()
    kept = files.select("repo", "path", "blob").join(removed.unionByName(written).distinct(), ["repo", "path"], "left_anti")
    return kept.unionByName(tip.select("repo", "path", "blob").join(written, ["repo", "path"], "left_semi"))


def op_counts(ops: DataFrame) -> DataFrame:
    """(repo, op, n): operations by kind."""
    return ops.groupBy("repo", "op").agg(F.count(F.lit(1)).alias("n"))


def op_totals(ops: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, op, n, verdict): a repository's operations by kind, and one row with a null op for all of them.

    repos: (repo, anchor_label, tip_label), every repository of the fleet. Without operations its one row tells why:
    at-head where both labels are the same, else moved, as upstream went on but changed nothing managed. With any:
    syncing. Unknown labels are not the same.
    """
    counts = ops.rollup("repo", "op").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).where("level < 3").drop("level")
    told = repos.select("repo", "anchor_label", "tip_label").join(counts, "repo", "left")
    verdict = F.when(F.col("n").isNotNull(), "syncing").when(F.coalesce(F.col("anchor_label") == F.col("tip_label"), F.lit(False)), "at-head").otherwise("moved")
    return told.select("repo", "op", F.coalesce("n", F.lit(0).cast("long")).alias("n"), verdict.alias("verdict"))


#: The words that stand for operations in reports.
OP_WORDS = {"A": "add", "M": "update", "D": "delete", "R": "rename", "C": "copy"}


def op_labels(ops: DataFrame) -> DataFrame:
    """ops with a label: the word, or the operation where it has none, padded to eight, and the path or `old -> new`."""
    word = F.coalesce(F.create_map(*[F.lit(x) for pair in OP_WORDS.items() for x in pair])[F.col("op")], F.col("op"))
    where = F.when(F.col("op").isin("R", "C"), F.concat_ws(" -> ", "old_path", "path")).otherwise(F.col("path"))
    return ops.withColumn("label", F.concat(F.rpad(word, 8, " "), where))


def covered_paths(ops: DataFrame) -> DataFrame:
    """(repo, path): every path that operations name, old or new."""
    return ops.select("repo", F.explode(F.array("path", "old_path")).alias("path")).where("path is not null").distinct()
