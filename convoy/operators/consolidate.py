"""Scattered documents into one dated, deduplicated archive: routes, dates, destinations, the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.functions.text import display_name, feature_slug, leaf, linked_issues, short_hash, trimmed
from convoy.sources.shared import materialize


def route_document(path: Column) -> Column:
    """struct(source_type, kind, dest_dir, base, rank); null for paths that stay where they are."""
    p = F.regexp_replace(path, r"\\", "/")
    name = leaf(p)
    session = F.regexp_extract(p, r"(?i)^sessions/([^/]+)/plan\.md$", 1)

    def to(source_type: str, kind: str, folder: str, base: Column, rank: int) -> Column:
        return F.struct(F.lit(source_type).alias("source_type"), F.lit(kind).alias("kind"), F.lit(folder).alias("dest_dir"), base.alias("base"), F.lit(rank).alias("rank"))

    specs, designs = "docs/specs", "docs/designs"
    return (
        F.when(p.rlike(r"(?i)^tasks/[^/]*-prd\.md$"), to("legacy-tasks", "-prd", specs, feature_slug(name), 1))
        .when(p.rlike(r"(?i)^tasks/[^/]*-plan\.md$"), to("legacy-tasks", "-plan", designs, feature_slug(name), 1))
        .when(p.rlike(r"(?i)^docs/prd/[^/]+\.md$"), to("docs/prd", "-prd", specs, feature_slug(name), 2))
        .when(F.lower(p) == "prd.md", to("root-doc", "-prd", specs, F.lit("legacy"), 3))
        .when(F.lower(p).isin("plan.md", "implementation_plan.md"), to("root-doc", "-plan", designs, F.lit("legacy"), 3))
        .when(session != "", to("copilot-session", "-plan", designs, F.concat(F.lit("session-"), F.substring(session, 1, 8)), 4))
        .when(p.rlike(r"(?i)^claude/.*plan[^/]*\.md$"), to("claude-session", "-plan", designs, F.concat(F.lit("claude-"), short_hash(path)), 5))
    )


def first_added(commit_files: DataFrame) -> DataFrame:
    """(repo, path, author_date): when the file that a path has now was first added, following renames back as of their time.

    A rename leads to its old name as it was then: to the last rename into that name before it, else to the
    oldest event of that name before it. So a name that was used before, or is used again, isn't taken for
    another file's. Each round doubles how far every rename looks back, so a chain of n takes log2(n) rounds.
    """
    events = commit_files.select("repo", "path", "old_path", "seq", "author_date")
    renames = events.where("old_path is not null").groupBy("repo", "path", "seq").agg(F.max_by(F.struct("old_path", "author_date"), F.struct("author_date", "old_path")).alias("e"))
    renames = materialize(renames.select("repo", "path", "seq", "e.old_path", F.col("e.author_date").alias("own")), "renames")
    # An as-of join in one pass by name: who asks for a name, and when, beside what happened to it.
    asks = renames.select("repo", F.col("old_path").alias("name"), "seq", F.lit(0).alias("kind"), F.struct("path", "own").alias("asker"), F.lit(None).cast(events.schema["author_date"].dataType).alias("date"), F.lit(False).alias("into"))
    happened = events.select("repo", F.col("path").alias("name"), "seq", F.lit(1).alias("kind"), F.lit(None).cast(asks.schema["asker"].dataType).alias("asker"), F.col("author_date").alias("date"), F.col("old_path").isNotNull().alias("into"))
    before = W.partitionBy("repo", "name").orderBy("seq", "kind").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("into"), F.col("seq")), ignorenulls=True).over(before)
    oldest = F.first("date", ignorenulls=True).over(before)
    placed = asks.unionByName(happened).withColumns({"last": last, "oldest": oldest}).where("kind = 0")
    up = F.when(F.col("last").isNotNull(), F.struct(F.col("name").alias("path"), F.col("last").alias("seq")))
    chains = placed.select("repo", F.col("asker.path").alias("path"), "seq", F.when(up.isNotNull(), F.col("asker.own")).otherwise(F.coalesce("oldest", F.col("asker.own"))).alias("date"), up.alias("up"))
    chains = materialize(chains, "first_added")
    # Time goes back at each step, so nothing runs in a circle.
    while not chains.where("up is not null").isEmpty():
        far = chains.select("repo", F.struct("path", "seq").alias("up"), F.col("date").alias("far_date"), F.col("up").alias("far_up"))
        going = chains.where("up is not null").join(far, ["repo", "up"]).select("repo", "path", "seq", F.col("far_date").alias("date"), F.col("far_up").alias("up"))
        chains = materialize(chains.where("up is null").unionByName(going), "first_added")
    now = chains.groupBy("repo", "path").agg(F.max_by("date", "seq").alias("date"))
    born = events.groupBy("repo", "path").agg(F.min_by("author_date", "seq").alias("born"))
    return born.join(now, ["repo", "path"], "left").select("repo", "path", F.coalesce("date", "born").alias("author_date"))


def source_dates(docs: DataFrame, commit_files: DataFrame) -> DataFrame:
    """docs (repo, path, mtime) with source_date: in the name, else when first added, else the last write (UTC)."""
    named = F.nullif(F.regexp_extract(leaf(F.col("path")), r"^(\d{4}-\d{2}-\d{2})-", 1), F.lit(""))
    added = first_added(commit_files)
    return docs.join(added, ["repo", "path"], "left").withColumn("source_date", F.coalesce(named, F.col("author_date").cast("string"), F.date_format("mtime", "yyyy-MM-dd"))).drop("author_date")


def resolve_destinations(docs: DataFrame) -> DataFrame:
    """docs (repo, dest_dir, base, extension, rank, path, content, and kind if any) with destination, action and note.

    Rank 0 is the archive itself. A name is the base with the kind's suffix. Of one name the first
    claimant gets it bare; equal content is skipped, with a note and the place that has the name;
    other content gets its short hash, and a second one of that skips too. Contents are compared by
    hash, case counting.
    """
    if "kind" in docs.columns:
        docs = docs.withColumn("base", F.concat("base", F.coalesce("kind", F.lit("")))).drop("kind")
    digest = F.sha1("content")
    claim = W.partitionBy("repo", "dest_dir", "base", "extension").orderBy("rank", "path")
    same = W.partitionBy("repo", "dest_dir", "base", "extension", "_hash").orderBy("rank", "path")
    ranked = docs.withColumn("_hash", digest).withColumn("_first", F.first("_hash").over(claim)).withColumn("_n", F.row_number().over(claim)).withColumn("_again", F.row_number().over(same))
    bare = F.concat("dest_dir", F.lit("/"), "base", "extension")
    suffixed = F.concat(F.col("dest_dir"), F.lit("/"), F.col("base"), F.lit("-"), F.substring("_hash", 1, 8), F.col("extension"))
    action = F.when(F.col("rank") == 0, "keep").when(F.col("_n") == 1, "move").when((F.col("_hash") == F.col("_first")) | (F.col("_again") > 1), "skip").otherwise("move")
    destination = F.when((action == "skip") | (F.col("_n") == 1) | (F.col("rank") == 0), bare).otherwise(suffixed)
    note = F.when(action == "skip", "same content is in place")
    return ranked.withColumn("action", action).withColumn("destination", destination).withColumn("note", note).drop("_hash", "_first", "_n", "_again")


def repo_issues(docs: DataFrame, key: str = "repo", text: str = "content") -> DataFrame:
    """(key, issues): distinct issue numbers of all documents, ascending. Only numbers are shuffled."""
    numbers = docs.select(key, F.explode(linked_issues(F.col(text))).alias("n"))
    return numbers.groupBy(key).agg(F.array_sort(F.collect_set("n")).alias("issues"))


def match_sessions(sessions: DataFrame, repos: DataFrame) -> DataFrame:
    """(session_id, repo): by equal origin or root in any case, or by the root's leaf name inside either datum.

    repos: (repo, origin_url, root). For the containment each distinct datum is taken apart into its
    substrings of the lengths that leaf names have, which are then joined by equality.
    """
    data = sessions.select("session_id", F.explode(F.array("repository", "cwd")).alias("datum")).where("datum is not null and trim(datum) <> ''").select("session_id", F.lower(F.trim("datum")).alias("datum"))
    by_url = data.join(repos.select("repo", F.lower("origin_url").alias("datum")), "datum").select("session_id", "repo")
    by_root = data.join(repos.select("repo", F.lower("root").alias("datum")), "datum").select("session_id", "repo")
    names = repos.select("repo", F.lower(leaf(F.regexp_replace(F.col("root"), r"\\", "/"))).alias("leaf")).where("leaf <> ''")
    # File names have some hundred lengths at most, whatever the number of repositories.
    lengths = F.array(*[F.lit(r["n"]) for r in names.select(F.length("leaf").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    values = data.select("datum").distinct()
    fitting = values.select("datum", F.explode(F.filter(lengths, lambda n: n <= F.length("datum"))).alias("n"))
    starts = fitting.select("datum", "n", F.explode(F.sequence(F.lit(1), F.length("datum") - F.col("n") + 1)).alias("at"))
    parts = starts.select("datum", F.substring(F.col("datum"), F.col("at"), F.col("n")).alias("leaf")).distinct()
    by_leaf = data.join(parts.join(names, "leaf").select("datum", "repo"), "datum").select("session_id", "repo")
    return by_url.unionByName(by_root).unionByName(by_leaf).distinct()


def manifest(records: DataFrame) -> DataFrame:
    """Audit rows in order: by date with undated last, then source; issues as `#1 #2`."""
    issues = F.array_join(F.transform("issues", lambda n: F.concat(F.lit("#"), n.cast("string"))), " ")
    return records.select("date", "timestamp", "action", "type", "source", "destination", issues.alias("issues"), "note").orderBy(F.col("date").isNull(), "date", "source")


MANIFEST = ("date", "timestamp", "action", "type", "source", "destination", "issues", "note")


def write_manifest(records: DataFrame, path: str) -> None:
    """The manifest as Parquet, one folder per repository, each in order. Written again, a repository's folder is replaced and others stay.

    Rows of a large repository are ordered over several files, by ranges of (undated, date, source), so that no task
    holds a repository.
    """
    issues = F.array_join(F.transform("issues", lambda n: F.concat(F.lit("#"), n.cast("string"))), " ")
    order = [F.col("date").isNull().alias("undated"), F.col("date"), F.col("source")]
    rows = records.select("repo", *MANIFEST).withColumn("issues", issues)
    ranged = rows.repartitionByRange("repo", *order).sortWithinPartitions("repo", *order)
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What `write_manifest` left: repo and the manifest's columns."""
    return spark.read.schema(", ".join(f"{c} string" for c in (*MANIFEST, "repo"))).parquet(path).select("repo", *MANIFEST)


def issue_prompts(issues: DataFrame, most: int = 0, opening: str = "@dev-loop gh issue ") -> DataFrame:
    """issues (number, title, context) with name and prompt; without a number the title describes a new issue."""
    title = trimmed(F.coalesce("title", F.lit("")))
    flat = F.regexp_replace(title, r"(?U)\s+", " ")
    number = F.col("number").cast("string")
    fresh = F.when(title != "", F.concat(F.lit("new: "), title)).otherwise("new issue")
    name = display_name(F.when(number.isNotNull(), F.concat(number, F.lit(": "), F.coalesce("title", F.lit("")))).otherwise(fresh), most)
    line = F.concat(F.lit(opening), number, F.when(flat != "", F.concat(F.lit(": "), flat)).otherwise(""))
    context = trimmed(F.replace(F.coalesce("context", F.lit("")), F.lit("\r\n"), F.lit("\n")))
    return issues.withColumn("name", name).withColumn("prompt", F.when(context != "", F.concat(line, F.lit("\n\n"), context)).otherwise(line))
