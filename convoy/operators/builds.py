"""Which builds are stale, which restores are due, and what build logs say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.functions.text import ancestors, assembly_name, is_diagnostic, is_restore_failure, is_runnable, leaf, severity, trimmed
from convoy.sources.dumps import file_inventory

#: What a build and a restore read, and the folders that neither looks into.
SOURCES = (".cs", ".csproj", ".props", ".targets", ".sln", ".slnx", ".razor", ".cshtml", ".resx", ".vb", ".vbproj", ".fs", ".fsproj")
RESTORE_EXTENSIONS = (".csproj", ".fsproj", ".vbproj", ".props", ".targets")
RESTORE_NAMES = ("nuget.config", "global.json", "packages.lock.json")
PRUNED = ("bin", "obj", ".git", ".worktrees", ".claude", ".vs", "node_modules")
PLAN_NAMES = ("Directory.Build.props", "Directory.Build.targets", "Directory.Packages.props")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def newest_assembly(projects: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, project, assembly_path, assembly_mtime): the newest `<assembly>.dll` below the project's bin folder.

    projects: (repo, project, assembly), project being the project file's path.
    """
    wanted = projects.select("repo", "project", F.concat_ws("/", F.nullif(folder(F.col("project")), F.lit("")), F.lit("bin")).alias("place"), F.lower(F.concat("assembly", F.lit(".dll"))).alias("name"))
    built = inventory.where(F.lower("path").endswith(".dll")).select("repo", "path", "mtime", F.lower(leaf(F.col("path"))).alias("name"), F.explode(ancestors(F.col("path"))).alias("place"))
    found = wanted.join(built, ["repo", "place", "name"])
    return found.groupBy("repo", "project").agg(F.max_by("path", F.struct("mtime", "path")).alias("assembly_path"), F.max("mtime").alias("assembly_mtime"))


def build_staleness(projects: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, project, build_required): no assembly, or a source newer than it; equal times are fresh, no source is fresh."""
    sources = file_inventory(inventory, SOURCES, (), PRUNED).groupBy("repo").agg(F.max("mtime").alias("source_mtime"))
    out = projects.select("repo", "project").join(newest_assembly(projects, inventory), ["repo", "project"], "left").join(sources, "repo", "left")
    required = F.when(F.col("assembly_mtime").isNull(), True).otherwise(F.coalesce(F.col("source_mtime") > F.col("assembly_mtime"), F.lit(False)))
    return out.select("repo", "project", required.alias("build_required"))


def restore_required(projects: DataFrame, inventory: DataFrame, stamp: str, assets: str = "project.assets.json") -> DataFrame:
    """(repo, project, restore_required): the stamp or assets are missing, or an input is newer than the stamp."""
    inputs = file_inventory(inventory, RESTORE_EXTENSIONS, RESTORE_NAMES, PRUNED).groupBy("repo").agg(F.max("mtime").alias("input_mtime"))
    place = F.concat_ws("/", F.nullif(folder(F.col("project")), F.lit("")), F.lit("obj"))
    obj = inventory.select("repo", "path", "mtime")
    out = projects.select("repo", "project", F.concat_ws("/", place, F.lit(stamp)).alias("s"), F.concat_ws("/", place, F.lit(assets)).alias("a"))
    out = out.join(obj.select("repo", F.col("path").alias("s"), F.col("mtime").alias("stamp_mtime")), ["repo", "s"], "left").join(obj.select("repo", F.col("path").alias("a"), F.lit(True).alias("has_assets")), ["repo", "a"], "left").join(inputs, "repo", "left")
    due = F.when(F.col("stamp_mtime").isNull() | F.col("has_assets").isNull(), True).otherwise(F.coalesce(F.col("input_mtime") > F.col("stamp_mtime"), F.lit(False)))
    return out.select("repo", "project", due.alias("restore_required"))


def launch_plan_current(plans: DataFrame, inventory: DataFrame) -> DataFrame:
    """(repo, project, current): no input is newer than the plan, and the inputs are those recorded.

    plans: (repo, project, input, mtime). Inputs: the project, its launch settings, and the
    shared build files of every folder from the project's up to the root.
    """
    home = folder(F.col("project"))
    folders = F.concat(F.array(F.lit("")), F.when(home == "", F.array().cast("array<string>")).otherwise(ancestors(home)))
    in_folders = F.flatten(F.transform(folders, lambda d: F.array(*[F.concat_ws("/", F.nullif(d, F.lit("")), F.lit(n)) for n in PLAN_NAMES])))
    settings = F.concat_ws("/", F.nullif(home, F.lit("")), F.lit("Properties/launchSettings.json"))
    paths = F.concat(F.array(F.col("project"), settings), in_folders)
    asked = plans.select("repo", "project", F.col("mtime").alias("plan_mtime"), F.explode(F.array_distinct(paths)).alias("path"))
    there = asked.join(inventory.select("repo", "path", "mtime"), ["repo", "path"])
    existing = there.groupBy("repo", "project").agg(F.array_sort(F.collect_set("path")).alias("existing"), F.bool_or(F.col("mtime") > F.col("plan_mtime")).alias("newer"))
    out = plans.join(existing, ["repo", "project"], "left")
    none = F.array().cast("array<string>")
    current = ~F.coalesce("newer", F.lit(False)) & (F.coalesce("existing", none) == F.array_sort(F.coalesce("input", none)))
    return out.select("repo", "project", current.alias("current"))


def build_log_flags(lines: DataFrame) -> DataFrame:
    """lines with is_diagnostic, is_restore_failure and severity."""
    line = F.col("line")
    return lines.withColumns({"is_diagnostic": is_diagnostic(line), "is_restore_failure": is_restore_failure(line), "severity": severity(line)})


def shown(line: Column, width: int) -> Column:
    flat = F.replace(trimmed(line), F.lit("\t"), F.lit("    "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def log_tail(lines: DataFrame, n: int = 10, width: int = 80) -> DataFrame:
    """(build_id, line_no, shown): each build's last n lines that aren't blank, which is what a tail is, cut to the width."""
    solid = lines.where(trimmed(F.col("line")) != "")
    last = F.row_number().over(W.partitionBy("build_id").orderBy(F.desc("line_no")))
    return solid.withColumn("_r", last).where(F.col("_r") <= n).select("build_id", "line_no", shown(F.col("line"), width).alias("shown"))


def suite_verdict(runs: DataFrame, expected: DataFrame, containers: DataFrame) -> DataFrame:
    """(run_id, reasons, missing): why a test run isn't green, empty if it is, and the expected files that made no container.

    runs: (run_id, total, failed, result), null where there is no result. expected: (run_id, file), the files that
    were found; containers: (run_id, file), the files that ran. Files that ran without being expected are no fault.
    A run that only expected names has no result.
    """
    # One row per file and one per run: no join holds both sides' files at once. A null name is equal to none.
    both = expected.select("run_id", "file", F.lit(True).alias("wanted"), F.lit(False).alias("ran")).unionByName(containers.select("run_id", "file", F.lit(False).alias("wanted"), F.lit(True).alias("ran")))
    files = both.groupBy("run_id", "file").agg(F.max("wanted").alias("wanted"), (F.max("ran") & F.col("file").isNotNull()).alias("ran")).where("wanted")
    lost = ~F.col("ran") & F.col("run_id").isNotNull()
    names = F.array_sort(F.collect_list(F.when(lost, F.col("file"))))
    found = files.groupBy("run_id").agg(F.when(F.max(lost), names).alias("missing"))
    per = found.join(runs, "run_id", "full")
    none = F.col("result").isNull()
    reasons = [
        (none, "no-result"),
        (~none & (F.coalesce("total", F.lit(0)) < 1), "no-tests"),
        (~none & (F.coalesce("failed", F.lit(0)) > 0), "failed"),
        (~none & (F.col("result") != "Passed"), "not-passed"),
        (F.col("missing").isNotNull(), "missing-files"),
    ]
    listed = F.coalesce("missing", F.array().cast(expected.select(F.array("file")).schema[0].dataType))
    return per.select("run_id", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons])).alias("reasons"), listed.alias("missing"))


def runnable_projects(projects: DataFrame) -> DataFrame:
    """(repo, path, assembly): project files that build something to run."""
    return projects.where(is_runnable(F.col("content"))).select("repo", "path", assembly_name(F.col("content"), F.col("path")).alias("assembly"))
