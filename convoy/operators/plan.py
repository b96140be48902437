"""Which operations bring each repository up to date, and by which route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions.rules import Rules, is_delivered, is_private, matches
from convoy.functions.text import blank, comparable_remote
from convoy.operators.drift import content_key
from convoy.operators.snapshots import covered_paths


#: Entries of a scaffold map up to which it is broadcast.
MOST_SCAFFOLDS = 10_000


def sync_plan(anchor_ops: DataFrame, head_ops: DataFrame, prune_ops: DataFrame, yielded: DataFrame) -> DataFrame:
    """(repo, op, path, old_path, origin): anchor-to-tip operations, then head-to-tip ones that they don't cover, then prunes.

    Whatever touches a yielded path, old or new, is left out.
    """
    names = ("repo", "op", "path", "old_path")
    left = yielded.select("repo", "path").distinct()

    def open_ops(ops: DataFrame) -> DataFrame:
        ops = ops.select(*names).join(left, ["repo", "path"], "left_anti")
        return ops.join(left.select("repo", F.col("path").alias("old_path")), ["repo", "old_path"], "left_anti").select(*names)

    def uncovered(ops: DataFrame, done: DataFrame) -> DataFrame:
        covered = covered_paths(done)
        ops = ops.join(covered, ["repo", "path"], "left_anti")
        return ops.join(covered.select("repo", F.col("path").alias("old_path")), ["repo", "old_path"], "left_anti").select(*names)

    first = open_ops(anchor_ops)
    second = uncovered(open_ops(head_ops), first)
    third = uncovered(open_ops(prune_ops), first.unionByName(second))
    tagged = [df.withColumn("origin", F.lit(tag)) for df, tag in ((first, "anchor"), (second, "head"), (third, "prune"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def prune_private(tracked: DataFrame, rules: Rules, upstreams: DataFrame, below: str = ".github/") -> DataFrame:
    """Delete operations for private paths below one folder; never in the upstream itself."""
    gone = tracked.where(F.lower("path").startswith(below) & is_private(F.col("path"), rules))
    gone = gone.join(upstreams.select("repo").distinct(), "repo", "left_anti")
    return gone.select("repo", F.lit("D").alias("op"), "path", F.lit(None).cast("string").alias("old_path")).distinct()


def scaffold_plan(scaffolds: DataFrame, tip: DataFrame, consumer: DataFrame, upstreams: DataFrame) -> DataFrame:
    """(repo, template, target): scaffolds whose target is missing and whose source exists.

    A scaffold of its own name comes from the tip; a template from the consumer's synced tree.
    """
    repos = consumer.select("repo").distinct().join(upstreams.select("repo").distinct(), "repo", "left_anti")
    # Every repository has every entry of the map. A longer map is dealt by Spark, not sent to each task.
    listed = scaffolds.select("template", "target").distinct()
    wanted = repos.crossJoin(F.broadcast(listed) if listed.limit(MOST_SCAFFOLDS + 1).count() <= MOST_SCAFFOLDS else listed)
    missing = wanted.join(consumer.select("repo", F.col("path").alias("target")), ["repo", "target"], "left_anti")
    own = F.col("template") == F.col("target")
    in_tip = missing.where(own).join(tip.select("repo", F.col("path").alias("template")), ["repo", "template"], "left_semi")
    in_tree = missing.where(~own).join(consumer.select("repo", F.col("path").alias("template")), ["repo", "template"], "left_semi")
    return in_tip.unionByName(in_tree).select("repo", "template", "target")


def resolve_anchor(repos: DataFrame, state: DataFrame, commits: DataFrame, managed: DataFrame, pattern: str, no_prompt: bool = False) -> DataFrame:
    """(repo, sha, source): the first of an explicit bootstrap, the state, the newest matching commit, and a bootstrap.

    repos: (repo, bootstrap). pattern: of a line in a sync commit's message; case counts.
    A bootstrap has no sha. Both null: a person must decide.
    """
    logged = commits.where(F.col("message").rlike(f"(?m){pattern}")).groupBy("repo").agg(F.max_by("sha", "seq").alias("log_sha"))
    has = managed.select("repo").distinct().withColumn("has_managed", F.lit(True))
    all_known = repos.join(state.select("repo", F.col("last_sync_commit").alias("state_sha")), "repo", "left").join(logged, "repo", "left").join(has, "repo", "left")
    source = (
        F.when(F.col("bootstrap"), "bootstrap")
        .when(F.col("state_sha").isNotNull(), "state")
        .when(F.col("log_sha").isNotNull(), "grep")
        .when(F.col("has_managed").isNull(), "auto-bootstrap")
        .when(F.lit(no_prompt), "bootstrap")
    )
    sha = F.when(source == "state", F.col("state_sha")).when(source == "grep", F.col("log_sha"))
    return all_known.select("repo", sha.alias("sha"), source.alias("source"))


def is_self_sync(origin: Column, upstream: Column) -> Column:
    """One repository on both ends; false if either url is missing."""
    return F.coalesce(comparable_remote(origin) == comparable_remote(upstream), F.lit(False))


def is_upstream_named(origin: Column, name: str) -> Column:
    """The url's last part is the upstream's name in any case, which forks share."""
    return F.coalesce(F.element_at(F.split(F.regexp_replace(comparable_remote(origin), ":", "/"), "/"), -1) == name.lower(), F.lit(False))


def sync_route(repos: DataFrame) -> DataFrame:
    """(repo, code, commit_on_main, action): how a sync can be delivered.

    repos: (repo, origin_url, has_default_commit, first_sync, exact_branch, has_tracking_ref, query_ok).
    A remote that could not be asked may well have the branch.
    """
    code = F.when(~F.col("has_default_commit"), "NoProtectedCommit").when(blank(F.col("origin_url")), "NoOrigin").otherwise("Viable")
    remote_has = F.coalesce("exact_branch", F.lit(False)) | F.col("has_tracking_ref") | ~F.col("query_ok")
    return repos.select(
        "repo",
        code.alias("code"),
        (F.col("first_sync") & (code != "Viable")).alias("commit_on_main"),
        F.when(remote_has, "Proceed").otherwise("Skip").alias("action"),
    )


def unmanaged_repos(files: DataFrame, rules: Rules) -> DataFrame:
    """(repo): repositories without any managed file; the meta class doesn't count."""
    managed = files.where(is_delivered(F.col("path"), rules) & ~matches(F.col("path"), rules, "meta"))
    return files.select("repo").distinct().join(managed.select("repo").distinct(), "repo", "left_anti")


def worktree_file_cleanup(candidates: DataFrame, tip: DataFrame, history: DataFrame) -> DataFrame:
    """(repo, path, decision) for candidates (repo, path, xy, blob, content) that the tip knows.

    Modified and at the tip: revert. Untracked and from any upstream version: delete. Modified
    to an older upstream version: keep-pin, it may be deliberate. Else: keep-local.
    """
    untracked = F.col("xy") == "??"
    modified = F.col("xy").startswith("M") | F.col("xy").endswith("M")
    asked = candidates.where(untracked | modified).withColumn("_key", content_key())
    at_tip = asked.join(tip.select("repo", "path", F.col("blob").alias("_tip")), ["repo", "path"])
    known = history.select("repo", "path", content_key().alias("_key")).distinct().withColumn("_known", F.lit(True))
    placed = at_tip.join(known, ["repo", "path", "_key"], "left")
    same, sourced = F.col("blob") == F.col("_tip"), (F.col("blob") == F.col("_tip")) | F.col("_known").isNotNull()
    decision = F.when(same & ~untracked, "revert").when(~sourced, "keep-local").when(untracked, "delete").otherwise("keep-pin")
    return placed.select("repo", "path", decision.alias("decision"))
