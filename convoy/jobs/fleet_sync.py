"""The fleet's sync plan from snapshots to operations, and its summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.rules import Rules
from convoy.operators import drift, plan, snapshots
from convoy.sources.shared import materialize


@dataclass(frozen=True)
class Fleet:
    """anchor, tip and head snapshots, upstream's history, uncommitted status, and the upstream's own repositories."""

    anchor: DataFrame
    tip: DataFrame
    head: DataFrame
    history: DataFrame
    status: DataFrame
    upstreams: DataFrame


def sync_plan(fleet: Fleet, rules: Rules) -> DataFrame:
    """(repo, op, path, old_path, origin) for every repository of the fleet."""
    drifted = drift.local_drift(fleet.head, fleet.anchor, fleet.history, rules)
    # Plans are small beside the snapshots: each part is computed once and written.
    yielded = materialize(drift.yielded_paths(fleet.status, drifted, rules), "yielded")
    anchor_ops = materialize(snapshots.without_owned(snapshots.detect_renames(snapshots.snapshot_diff(fleet.anchor, fleet.tip, rules)), rules), "anchor_ops")
    # Head to tip: deletions at head are the consumer's, so only what the tip has counts.
    head_ops = materialize(snapshots.snapshot_diff(fleet.head, fleet.tip, rules).where("op <> 'D'"), "head_ops")
    prune = plan.prune_private(fleet.head, rules, fleet.upstreams)
    return plan.sync_plan(anchor_ops, head_ops, prune, yielded)


def blocked(fleet: Fleet, rules: Rules) -> DataFrame:
    """(repo, n_drifted): repositories whose drift, but for yielded paths, blocks the sync unless forced."""
    drifted = drift.local_drift(fleet.head, fleet.anchor, fleet.history, rules)
    yielded = drift.yielded_paths(fleet.status, drifted, rules)
    return drifted.join(yielded.select("repo", "path"), ["repo", "path"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("n_drifted"))


def summary(fleet: Fleet, rules: Rules) -> DataFrame:
    """(repo, op, n) over the plan."""
    return snapshots.op_counts(sync_plan(fleet, rules))


def verdicts(fleet: Fleet, rules: Rules, repos: DataFrame) -> DataFrame:
    """(repo, op, n, verdict) over the plan, for every repository of repos (repo, anchor_label, tip_label)."""
    return snapshots.op_totals(sync_plan(fleet, rules), repos)
