"""Desired against actual links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_links(desired: DataFrame, actual: DataFrame, owned: Sequence[str], keys: tuple[str, ...] = ("home", "name")) -> DataFrame:
    """(keys, status): Missing, Skipped (a real folder), Unchanged, Linked; Removed for dangling links into owned folders.

    desired: source, source_exists. actual: is_link, target, target_exists. Targets are compared
    without a trailing slash and in any case. What is neither desired nor to be removed is left out;
    a wanted link whose source is gone can be both Missing and Removed.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"[/\\]+$", ""))
    both = desired.withColumn("_wanted", F.lit(True)).join(actual.withColumn("_there", F.lit(True)), list(keys), "full")
    ours = reduce(lambda a, b: a | b, [F.lower("target").startswith(p.lower()) for p in owned], F.lit(False))
    dangling = F.col("is_link") & ~F.col("target_exists") & ours
    plan = (
        F.when(F.col("_wanted").isNull(), None)
        .when(~F.col("source_exists"), "Missing")
        .when(F.col("_there").isNull(), "Linked")
        .when(~F.col("is_link"), "Skipped")
        .when(plain(F.col("target")) == plain(F.col("source")), "Unchanged")
        .otherwise("Linked")
    )
    # A link that stays as it was may dangle, whether it is wanted or not.
    removed = F.when(F.coalesce(dangling, F.lit(False)) & (F.col("_wanted").isNull() | ~F.col("source_exists")), "Removed")
    return both.select(*keys, F.explode(F.array_compact(F.array(plan, removed))).alias("status"))
