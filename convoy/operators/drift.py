"""What was edited locally, really: managed files that differ from their anchor and from all of upstream's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.rules import Rules, is_delivered, matches
from convoy.functions.text import eol_normalize


def content_key(column: str = "content") -> Column:
    """One hash for contents that differ in carriage returns at line ends only."""
    return F.sha1(eol_normalize(F.col(column)))


def in_upstream_history(files: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Files whose content is some version of that very path, exactly or but for line ends."""
    known = history.select(*keys, content_key().alias("_key")).distinct()
    return files.withColumn("_key", content_key()).join(known, [*keys, "_key"], "left_semi").drop("_key")


def last_commit_touching(commit_files: DataFrame) -> DataFrame:
    """(repo, path, sha, seq, and subject if the dump has it): the newest commit of each path."""
    own = ["sha", "seq", *(["subject"] if "subject" in commit_files.columns else [])]
    newest = F.max_by(F.struct(*own), "seq")
    return commit_files.groupBy("repo", "path").agg(newest.alias("c")).select("repo", "path", *[f"c.{c}" for c in own])


def local_drift(head: DataFrame, anchor: DataFrame, history: DataFrame, rules: Rules, commit_files: DataFrame | None = None) -> DataFrame:
    """(repo, path[, sha]): managed paths at head whose content is neither the anchor's nor any historical one.

    A path that is missing at head is no drift; one that the anchor lacks can be. Line ends
    don't count. Contents are hashed where they are read and stay out of the shuffle.
    """
    managed = is_delivered(F.col("path"), rules)
    ours = head.where(managed).select("repo", "path", "blob", content_key().alias("_key"))
    base = anchor.where(managed).select("repo", "path", F.col("blob").alias("_blob"), content_key().alias("_base"))
    changed = ours.join(base, ["repo", "path"], "left").where("_blob is null or (blob <> _blob and _key <> _base)")
    known = history.where(managed).select("repo", "path", content_key().alias("_key")).distinct()
    drift = changed.join(known, ["repo", "path", "_key"], "left_anti").select("repo", "path")
    if commit_files is None:
        return drift
    return drift.join(last_commit_touching(commit_files).select("repo", "path", "sha"), ["repo", "path"], "left")


def yielded_paths(status: DataFrame, drift: DataFrame, rules: Rules) -> DataFrame:
    """(repo, path, reason): yield paths left to the consumer; an uncommitted change is named before committed drift."""
    fits = matches(F.col("path"), rules, "yield")
    dirty = status.where(fits).select("repo", "path", F.lit("uncommitted").alias("a")).distinct()
    drifted = drift.where(fits).select("repo", "path", F.lit("committed").alias("b")).distinct()
    return dirty.join(drifted, ["repo", "path"], "full").select("repo", "path", F.coalesce("a", "b").alias("reason"))
