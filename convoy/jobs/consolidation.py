"""Scattered documents into one archive, from routes to the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions.text import linked_issues
from convoy.operators import consolidate


def consolidation(docs: DataFrame, archive: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repo, date, timestamp, action, type, source, destination, issues, note): what becomes of every routed document.

    docs: (repo, path, content, mtime). archive: (repo, dest_dir, base, extension, path, content), what
    is in place already and keeps its names. commit_files: (repo, path, old_path, seq, author_date).
    Documents without a route stay where they are. `consolidate.manifest` puts the rows in order.
    """
    routed = docs.withColumn("route", consolidate.route_document(F.col("path"))).where("route is not null")
    dated = consolidate.source_dates(routed, commit_files)
    base = F.concat(F.col("route.base"), F.col("route.kind"))
    columns = ("repo", "dest_dir", "base", "extension", "rank", "path", "content", "source_date", "source_type")
    new = dated.select("repo", "route.dest_dir", base.alias("base"), F.lit(".md").alias("extension"), "route.rank", "path", "content", "source_date", "route.source_type").select(*columns)
    nothing = F.lit(None).cast("string")
    old = archive.select("repo", "dest_dir", "base", "extension", F.lit(0).alias("rank"), "path", "content", nothing.alias("source_date"), nothing.alias("source_type")).select(*columns)
    # A short digest and the numbers go on; contents stay where they are read.
    issues = F.when(F.col("rank") > 0, linked_issues(F.col("content")))
    placed = consolidate.resolve_destinations(new.unionByName(old).withColumn("issues", issues).withColumn("content", F.sha1("content"))).where("rank > 0")
    linked = F.when(F.col("action") == "skip", F.array().cast("array<int>")).otherwise(F.col("issues"))
    return placed.select("repo", F.col("source_date").alias("date"), nothing.alias("timestamp"), "action", F.col("source_type").alias("type"), F.col("path").alias("source"), "destination", linked.alias("issues"), "note")
