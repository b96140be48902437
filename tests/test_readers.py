"""Dumps and trees read from files give what the same rows give."""

from __future__ import annotations

import os

import pytest

from convoy.operators import builds
from convoy.sources import dumps, readers, shared


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_hold_over_blocks_and_files(spark, tmp_path, small_blocks):
    """Files that many tasks read, two for one repository, with blank lines: numbers count on, and stanzas stay together."""
    path = (tmp_path / "dumps").as_uri()
    lines = {"r": [], "a b/c": ["worktree /x", "", "locked"]}
    for i in range(150):
        lines["r"] += [f"worktree /w/{i}", f"branch refs/heads/b{i}", *(["locked why"] if i % 3 == 0 else []), ""]
    rows = [(repo, n, line) for repo, ls in lines.items() for n, line in enumerate(ls, 1)]
    df = spark.createDataFrame(rows, "repo string, line_no int, line string")
    readers.write_dump(df, path, "worktrees")
    readers.write_dump(spark.createDataFrame([("r", 1, "other source")], df.schema), path, "refs")
    assert spark.read.text(f"{path}/repo=r/source=worktrees").rdd.getNumPartitions() > 5
    got = readers.read_dump(spark, path, "worktrees")
    assert sorted((r.repo, r.line_no, r.line) for r in got.collect()) == sorted(rows)
    trees = {(r.repo, r.path, r.branch, r.locked) for r in dumps.parse_worktrees(got).collect()}
    assert trees == {("r", f"/w/{i}", f"b{i}", i % 3 == 0) for i in range(150)} | {("a b/c", "/x", None, True)}
    # Written again, one repository's dump is replaced.
    readers.write_dump(spark.createDataFrame([("r", 1, "worktree /only")], df.schema), path, "worktrees")
    assert [r.line for r in readers.read_dump(spark, path, "worktrees").where("repo = 'r'").collect()] == ["worktree /only"]


@pytest.mark.parametrize("spread", [0, 1, 2, 5])
def test_walk_prunes_and_does_not_follow_links(spark, tmp_path, spread):
    for name in ("obj/r/src/a.cs", "obj/r/src/Obj/b.cs", "obj/r/x/y/z/d.csproj", "obj/r/NuGet.config", "obj/r/bin/e.cs", "obj/r/empty/.keep", "two/a.cs"):
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text("text")
    os.symlink(tmp_path / "two", tmp_path / "obj/r/loop")
    os.symlink(tmp_path / "two/a.cs", tmp_path / "obj/r/link.cs")
    # A root below a folder with a pruned name is walked; one isn't there.
    roots = spark.createDataFrame([("r", (tmp_path / "obj/r").as_uri()), ("two", str(tmp_path / "two")), ("none", str(tmp_path / "none"))], "repo string, root string")
    got = readers.walk_files(roots, builds.PRUNED, spread)
    assert {(r.repo, r.path, r.size, r.is_link) for r in got.where("path not like '%link%' and path <> 'loop'").collect()} == {("r", p, 4, False) for p in ("src/a.cs", "x/y/z/d.csproj", "NuGet.config", "empty/.keep")} | {("two", "a.cs", 4, False)}
    assert {(r.path, r.is_link) for r in got.where("is_link").collect()} == {("loop", True), ("link.cs", True)}
    wanted = dumps.file_inventory(got.where("not is_link"), (".cs", ".csproj"), ("nuget.config",), ())
    assert {r.path for r in wanted.where("repo = 'r'").collect()} == {"src/a.cs", "x/y/z/d.csproj", "NuGet.config"}
    assert readers.walk_files(roots.limit(0), ()).count() == 0


def test_scratch_tables_go_with_their_job(spark):
    with shared.scratch(spark):
        kept = shared.materialize(spark.range(5), "inner")
        place = shared.fresh_path(spark, "own")
        spark.range(2).write.parquet(place)
        assert kept.count() == 5
    assert not os.path.exists(place.removeprefix("file:"))
    after = shared.materialize(spark.range(3), "outer")
    assert after.count() == 3 and "/job-" not in shared.fresh_path(spark, "x")
