"""Parsers of text dumps, one line per row. Order within a dump is an explicit line number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.functions.text import trimmed


def parse_name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with op, path, old_path. Score digits go; unknown operations and short lines are dropped."""
    parts = F.split(F.col(line), "\t")
    op = F.upper(F.substring(parts[0], 1, 1))
    moved = op.isin("R", "C")
    out = lines.withColumn("op", op).withColumn("path", F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))).withColumn("old_path", F.when(moved, F.get(parts, F.lit(1))))
    return out.where(op.isin("A", "M", "D", "T", "R", "C") & (F.size(parts) >= F.when(moved, 3).otherwise(2)))


def parse_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with xy, path, class (tracked, untracked, ignored); lines of three characters or fewer are dropped."""
    raw = F.col(line)
    rest = F.expr(f"substring(`{line}`, 4)")
    path = F.when(F.instr(rest, " -> ") > 0, rest).otherwise(F.regexp_replace(rest, r'^"+|"+$', ""))
    xy = F.substring(raw, 1, 2)
    kind = F.when(xy == "??", "untracked").when(xy == "!!", "ignored").otherwise("tracked")
    return lines.where(F.length(raw) > 3).withColumns({"xy": xy, "path": path, "class": kind})


def parse_worktrees(lines: DataFrame, line: str = "line") -> DataFrame:
    """(repo, path, branch, locked) from stanzas: `worktree` opens a record, the lines after it belong to it."""
    text = F.col(line)
    opens = text.startswith("worktree ")
    stanza = F.sum(opens.cast("int")).over(W.partitionBy("repo").orderBy("line_no"))
    marked = lines.withColumn("stanza", stanza).where(F.col("stanza") > 0)
    return (
        marked.groupBy("repo", "stanza")
        .agg(
            F.max(F.when(opens, F.expr(f"substring(`{line}`, 10)"))).alias("path"),
            F.max(F.when(text.startswith("branch refs/heads/"), F.expr(f"substring(`{line}`, 19)"))).alias("branch"),
            F.coalesce(F.bool_or(text.startswith("locked")), F.lit(False)).alias("locked"),
        )
        .drop("stanza")
    )


def parse_refs(lines: DataFrame, line: str = "line") -> DataFrame:
    """(repo, branch, gone): a branch is gone if its upstream says so and nothing else; blank lines are dropped."""
    text = trimmed(F.col(line))
    gone = text.rlike(r"^\S+\s+\[gone\]$")
    return lines.where(text != "").select("repo", F.regexp_extract(text, r"^(\S+)", 1).alias("branch"), gone.alias("gone"))


def has_exact_branch(lines: DataFrame, branch: str, key: str = "repo", line: str = "line") -> DataFrame:
    """(key, has_branch): whether a remote lists exactly refs/heads/<branch>; case counts."""
    ref = trimmed(F.get(F.split(F.col(line), "\t", 2), F.lit(1)))
    return lines.groupBy(key).agg(F.coalesce(F.bool_or(ref == f"refs/heads/{branch}"), F.lit(False)).alias("has_branch"))


STATE = "struct<remote:string,ref:string,lastSyncCommit:string,syncedAt:string>"


def read_sync_state(states: DataFrame, json: str = "json") -> DataFrame:
    """(repo, status, remote, ref, last_sync_commit, synced_at). status: absent (null or blank), corrupt (doesn't parse), no-commit, or known."""
    text = F.col(json)
    s = F.from_json(text, STATE)
    found = F.nullif(F.trim(s["lastSyncCommit"]), F.lit(""))
    status = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "absent").when(F.get_json_object(text, "$").isNull(), "corrupt").when(found.isNull(), "no-commit").otherwise("known")
    return states.select("repo", status.alias("status"), s["remote"].alias("remote"), s["ref"].alias("ref"), found.alias("last_sync_commit"), F.when(found.isNotNull(), F.try_to_timestamp(s["syncedAt"])).alias("synced_at"))


def advance_sync_state(state: DataFrame, ops: DataFrame, merges: DataFrame, tips: DataFrame, now: Column | None = None) -> DataFrame:
    """(repo, status, last_sync_commit, advanced, json): the anchor moves to the tip only if operations or merges took effect.

    json is the new state's text where it moved, else null: then the old text stays. A corrupt
    state never moves. now: the time of the sync in UTC.
    """
    n_ops = ops.groupBy("repo").agg(F.count(F.lit(1)).alias("n_ops"))
    n_merges = merges.groupBy("repo").agg(F.count(F.lit(1)).alias("n_merges"))
    joined = state.select("repo", "status", "remote", "ref", "last_sync_commit").join(tips.select("repo", "tip_commit"), "repo", "left").join(n_ops, "repo", "left").join(n_merges, "repo", "left")
    moves = ((F.coalesce("n_ops", F.lit(0)) > 0) | (F.coalesce("n_merges", F.lit(0)) > 0)) & (F.col("status") != "corrupt")
    at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.to_json(F.struct("remote", "ref", F.col("tip_commit").alias("lastSyncCommit"), at.alias("syncedAt")))
    return joined.select("repo", "status", F.when(moves, F.col("tip_commit")).otherwise(F.col("last_sync_commit")).alias("last_sync_commit"), moves.alias("advanced"), F.when(moves, text).alias("json"))


def in_pruned(path: Column, pruned: Sequence[str]) -> Column:
    """Whether a directory of the path, below the root, has one of the names."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(p.lower()) for p in pruned]))


def file_inventory(files: DataFrame, extensions: Sequence[str], names: Sequence[str], pruned: Sequence[str]) -> DataFrame:
    """Files with a wanted extension or name in any case, not below a pruned directory."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    wanted = extension.isin([e.lower() for e in extensions]) | name.isin([n.lower() for n in names])
    return files.where(wanted & ~in_pruned(F.col("path"), pruned))
