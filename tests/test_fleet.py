"""Hand-written cases for the fleet operators."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convoy.functions import rules as R
from convoy.functions import text as X
from convoy.functions.rules import PathRule
from convoy.jobs.rules import FLEET_RULES
from convoy.operators import builds, cleanup, consolidate, drift, lines, links, plan, snapshots
from convoy.sources import dumps
from convoy.streaming import build_logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "slug"),
    [
        ("https://github.com/Owner/Repo.git", "Owner/Repo"),
        ("https://github.com/Owner/Repo", "Owner/Repo"),
        ("HTTPS://GitHub.com/Owner/Repo/", "Owner/Repo"),
        ("git@github.com:Owner/Repo.git", "Owner/Repo"),
        ("git@ssh.github.com:Owner/Repo.git", "Owner/Repo"),
        ("ssh://git@github.com/Owner/Repo.git", "Owner/Repo"),
        ("https://gitlab.com/Owner/Repo", None),
        ("", None),
        (None, None),
    ],
)
def test_github_slug(spark, url, slug):
    assert one(spark, X.github_slug(F.lit(url).cast("string"))) == slug


@pytest.mark.parametrize(("url", "same"), [("git@github.com:O/R", "o/r"), ("C:\\git\\R.git\\", "c:/git/r"), ("  ", None), ("/srv/x.git/", "/srv/x")])
def test_comparable_remote(spark, url, same):
    assert one(spark, X.comparable_remote(F.lit(url))) == same


def test_self_sync_needs_both_and_forks_differ(spark):
    f = lambda a, b: one(spark, plan.is_self_sync(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert f("git@github.com:O/R", "https://github.com/o/r.git")
    assert not f("git@github.com:fork/R", "https://github.com/o/r.git")
    assert not f(None, "https://github.com/o/r.git")
    assert one(spark, plan.is_upstream_named(F.lit("git@github.com:fork/R"), "r"))


OWN = (PathRule("always_local", "exact", "README.md"), PathRule("always_local", "exact", "own.template"), *FLEET_RULES, PathRule("merge", "exact", ".gitignore"))


@pytest.mark.parametrize(
    ("path", "owner", "private"),
    [
        ("readme.md", "always_local", False),
        ("./README.md", "always_local", False),
        (".\\readme.md", "always_local", False),
        ("own.template", "always_local", False),
        (".gitignore", "merge", False),
        ("", "other", False),
        (".github/", "managed", False),
        ("docs/specs/x.md", "always_local", False),
        ("docs/specs/x.template", "other", False),
        ("docs/specs/.gitkeep", "other", False),
        (".github/skills/own-x/tests/a.ps1", "always_local", False),
        (".github/skills/own-x/a.template", "managed", False),
        (".github/a/b/tests/x", "managed", True),
        (".github/mytests/x", "managed", False),
        (".GITHUB/fixtures/x", "managed", True),
    ],
)
def test_path_rules(spark, path, owner, private):
    assert one(spark, R.owner_class(F.lit(path), OWN)) == owner
    assert one(spark, R.is_private(F.lit(path), OWN)) == private


def test_exact_branch(spark):
    df = spark.createDataFrame([("a", "1\trefs/heads/main"), ("b", "1\trefs/heads/release/main"), ("c", "1\trefs/heads/Main"), ("d", "junk")], "repo string, line string")
    assert {r.repo: r.has_branch for r in dumps.has_exact_branch(df, "main").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_route_an_unasked_remote_is_not_absent(spark):
    rows = [("a", "u", True, True, False, False, True), ("b", "u", True, True, False, False, False), ("c", "", True, True, True, False, True), ("d", "u", False, False, None, True, True)]
    df = spark.createDataFrame(rows, "repo string, origin_url string, has_default_commit boolean, first_sync boolean, exact_branch boolean, has_tracking_ref boolean, query_ok boolean")
    got = {r.repo: (r.code, r.commit_on_main, r.action) for r in plan.sync_route(df).collect()}
    assert got == {"a": ("Viable", False, "Skip"), "b": ("Viable", False, "Proceed"), "c": ("NoOrigin", True, "Proceed"), "d": ("NoProtectedCommit", False, "Proceed")}


SNAP = "repo string, path string, mode string, blob string, content string"


def snap(spark, *rows):
    return spark.createDataFrame([("r", p, m, b, c) for p, m, b, c in rows], SNAP)


def test_diff_kinds_and_owned_paths(spark):
    left = snap(spark, (".github/m", "100644", "1", "a"), (".github/d", "100644", "2", "b"), (".github/t", "100644", "3", "c"), (".github/x", "100644", "4", "d"), ("docs/specs/s", "100644", "5", "e"))
    right = snap(spark, (".github/m", "100644", "9", "z"), (".github/a", "100644", "7", "y"), (".github/t", "120000", "3", "c"), (".github/x", "100755", "4", "d"), ("src/own", "100644", "8", "q"), (".github/tests/p", "100644", "8", "q"))
    got = {(r.op, r.path) for r in snapshots.snapshot_diff(left, right, FLEET_RULES).collect()}
    assert got == {("M", ".github/m"), ("D", ".github/d"), ("T", ".github/t"), ("M", ".github/x"), ("A", ".github/a")}
    empty = left.limit(0)
    assert {r.op for r in snapshots.snapshot_diff(empty, right, FLEET_RULES).collect()} == {"A"}
    assert snapshots.snapshot_diff(left, left, FLEET_RULES).isEmpty()


def test_renames_exact_before_similar(spark):
    body = "\n".join(f"line {i} of the text" for i in range(20))
    left = snap(spark, (".github/old", None, "b1", "same"), (".github/src", None, "b2", body), (".github/gone", None, "b3", "nothing alike"))
    right = snap(spark, (".github/new", None, "b1", "same"), (".github/dst", None, "b4", body + "\nmore"), (".github/other", None, "b5", "wholly different words"))
    ops = snapshots.snapshot_diff(left, right, FLEET_RULES)
    contents = left.unionByName(right).select("blob", "content")
    got = {(r.op, r.path, r.old_path) for r in snapshots.detect_similar_renames(ops, contents).collect()}
    assert got == {("R", ".github/new", ".github/old"), ("R", ".github/dst", ".github/src"), ("D", ".github/gone", None), ("A", ".github/other", None)}
    tree = {(r.path, r.blob) for r in snapshots.replay_ops(left, snapshots.detect_similar_renames(ops, contents), right).collect()}
    assert tree == {(r.path, r.blob) for r in right.collect()}


def test_replay_copy_keeps_its_source(spark):
    files, tip = snap(spark, ("a", None, "1", "x")), snap(spark, ("a", None, "1", "x"), ("b", None, "1", "x"))
    ops = spark.createDataFrame([("r", "C", "b", "a")], "repo string, op string, path string, old_path string")
    assert {r.path for r in snapshots.replay_ops(files, ops, tip).collect()} == {"a", "b"}
    labels = {r.label for r in snapshots.op_labels(ops).collect()}
    assert labels == {"copy    a -> b"}


def test_drift_ignores_line_ends_and_history(spark):
    anchor = snap(spark, (".github/crlf", None, "1", "a\nb\n"), (".github/edit", None, "2", "a"), (".github/old", None, "3", "v2"), (".github/gone", None, "4", "x"), ("src/own", None, "5", "o"))
    head = snap(spark, (".github/crlf", None, "11", "a\r\nb\r\n"), (".github/edit", None, "12", "mine"), (".github/old", None, "13", "v1"), (".github/kept", None, "14", "k"), ("src/own", None, "15", "changed"))
    history = spark.createDataFrame([("r", ".github/old", 1, "13", "v1")], "repo string, path string, seq long, blob string, content string")
    files = spark.createDataFrame([("r", ".github/edit", "s1", 1), ("r", ".github/edit", "s2", 2)], "repo string, path string, sha string, seq long")
    got = {(r.path, r.sha) for r in drift.local_drift(head, anchor, history, FLEET_RULES, files).collect()}
    assert got == {(".github/edit", "s2"), (".github/kept", None)}


def test_yield_names_uncommitted_first(spark):
    status = spark.createDataFrame([("r", ".github/agents/a")], "repo string, path string")
    drifted = spark.createDataFrame([("r", ".github/agents/a"), ("r", ".github/agents/b"), ("r", ".github/c")], "repo string, path string")
    assert {(r.path, r.reason) for r in drift.yielded_paths(status, drifted, FLEET_RULES).collect()} == {(".github/agents/a", "uncommitted"), (".github/agents/b", "committed")}


def test_anchor_order(spark):
    repos = spark.createDataFrame([("boot", True), ("state", False), ("log", False), ("new", False), ("ask", False)], "repo string, bootstrap boolean")
    state = spark.createDataFrame([("boot", "s0"), ("state", "s1")], "repo string, last_sync_commit string")
    commits = spark.createDataFrame([("state", "c0", 1, "chore: sync Tool"), ("log", "c1", 1, "chore: sync Tool"), ("log", "c2", 2, "x\nchore(a): sync Tool"), ("ask", "c3", 1, "CHORE: sync Tool")], "repo string, sha string, seq long, message string")
    managed = spark.createDataFrame([("ask",), ("log",)], "repo string")
    got = {r.repo: (r.sha, r.source) for r in plan.resolve_anchor(repos, state, commits, managed, "^chore.*sync.*Tool").collect()}
    assert got == {"boot": (None, "bootstrap"), "state": ("s1", "state"), "log": ("c2", "grep"), "new": (None, "auto-bootstrap"), "ask": (None, None)}


def test_state_moves_only_with_effect(spark):
    text = '{"remote":"u","ref":"m","lastSyncCommit":"c","syncedAt":"2024-01-02T03:04:05Z"}'
    state = dumps.read_sync_state(spark.createDataFrame([("a", text), ("b", text), ("c", "{"), ("d", None)], "repo string, json string"))
    assert {r.repo: r.synced_at for r in state.collect()}["a"] == datetime(2024, 1, 2, 3, 4, 5)
    tips = spark.createDataFrame([(r, "tip") for r in "abcd"], "repo string, tip_commit string")
    ops, merges = spark.createDataFrame([("a",)], "repo string"), spark.createDataFrame([("c",)], "repo string")
    got = {r.repo: (r.last_sync_commit, r.advanced) for r in dumps.advance_sync_state(state, ops, merges, tips).collect()}
    assert got == {"a": ("tip", True), "b": ("c", False), "c": (None, False), "d": (None, False)}


def numbered(spark, *texts, key="f"):
    return spark.createDataFrame([(key, i, t) for i, t in enumerate(texts)], "file_id string, line_no int, line string")


def merged(spark, upstream, local):
    got = lines.merge_ignore_lines(numbered(spark, *upstream), numbered(spark, *local)).collect()
    return got[0].text if got else None


def test_ignore_merge(spark):
    assert merged(spark, ["# c", "a", "", "# d", "b"], []) == "# c\na\n\n# d\nb\n"
    assert merged(spark, ["# c", "a", "b"], ["a"]) == "a\n\n# c\nb\n"
    assert merged(spark, ["a", "B"], ["a", "b"]) == "a\nb\n\nB\n"
    assert merged(spark, ["# only"], ["x"]) is None
    assert merged(spark, ["a"], [" a "]) is None
    assert merged(spark, ["n"], ["x\r", "y\r", "\r"]) == "x\r\ny\r\n\r\nn\r\n"
    assert merged(spark, ["# >>> Upstream-Only >>>", "secret", "# <<< upstream-only <<<", "k", "# >>> upstream-only >>>", "tail"], ["x"]) == "x\n\nk\n"


def test_chunks(spark):
    got = [(r.line, r.chunk_id) for r in lines.ignore_chunks(numbered(spark, "# a", "b", "# c", "d", "", "e")).orderBy("line_no").collect()]
    ids = [c for _, c in got]
    assert ids[0] == ids[1] < ids[2] == ids[3] < ids[4]


def test_managed_block(spark):
    rows = [("created", None), ("added", "text  \n\n"), ("updated", "x\n<B>\nold\n<E>\ny"), ("same", "<B>\r\nnew $1\r\n<E>"), ("twice", "<B><B><E>"), ("half", "<B>"), ("turned", "<E><B>")]
    got = {r.k: (r.status, r.new_text) for r in lines.upsert_managed_block(spark.createDataFrame(rows, "k string, text string"), "<B>", "<E>", F.lit("new $1")).collect()}
    assert got["created"] == ("Created", "<B>\nnew $1\n<E>\n")
    assert got["added"] == ("Added", "text\n\n<B>\nnew $1\n<E>\n")
    assert got["updated"] == ("Updated", "x\n<B>\nnew $1\n<E>\ny")
    assert got["same"][0] == "Unchanged"
    assert {got[k][0] for k in ("twice", "half", "turned")} == {"Skipped"}
    again = lines.upsert_managed_block(spark.createDataFrame([(got["updated"][1],)], "text string"), "<B>", "<E>", F.lit("new $1")).first()
    assert again.status == "Unchanged"


@pytest.mark.parametrize(("text", "issues"), [("closes #42", [42]), ("Refs #10 and #20", [10, 20]), ("abc#7", []), ("fixes #5, see #5", [5]), ("closes #5x", [5]), ("#99999999999", []), ("", [])])
def test_linked_issues(spark, text, issues):
    assert one(spark, X.linked_issues(F.lit(text))) == issues


@pytest.mark.parametrize(("name", "slug"), [("a-prd.md", "a"), ("2024-01-02-b-plan.md", "2024-01-02-b"), ("c-PRD.md", "c"), ("-prd.md", "untitled"), ("x.y-plan.md", "x.y")])
def test_feature_slug(spark, name, slug):
    assert one(spark, X.feature_slug(F.lit(name))) == slug


@pytest.mark.parametrize(("most", "name"), [(10, "a value..."), (0, "a value too long"), (2, ".."), (50, "a value too long")])
def test_display_name(spark, most, name):
    assert one(spark, X.display_name(F.lit(" a  value\ttoo\nlong "), most)) == name


def test_dates_and_destinations(spark):
    files = spark.createDataFrame([("r", "a", None, 1, "2020-01-01"), ("r", "b", "a", 2, "2022-01-01"), ("r", "c", "b", 3, "2024-01-01")], "repo string, path string, old_path string, seq long, author_date string")
    docs = spark.createDataFrame([("r", "c", datetime(2025, 1, 1)), ("r", "2023-05-06-x.md", datetime(2025, 1, 1)), ("r", "z", datetime(2025, 1, 1))], "repo string, path string, mtime timestamp")
    assert {r.path: r.source_date for r in consolidate.source_dates(docs, files).collect()} == {"c": "2020-01-01", "2023-05-06-x.md": "2023-05-06", "z": "2025-01-01"}
    rows = [("r", "d", "n", ".md", 0, "p0", "A"), ("r", "d", "n", ".md", 1, "p1", "A"), ("r", "d", "n", ".md", 1, "p2", "B"), ("r", "d", "n", ".md", 1, "p3", "B"), ("r", "d", "m", ".md", 1, "p4", "C")]
    got = {r.path: (r.action, r.destination) for r in consolidate.resolve_destinations(spark.createDataFrame(rows, "repo string, dest_dir string, base string, extension string, rank int, path string, content string")).collect()}
    assert got["p0"] == ("keep", "d/n.md") and got["p1"] == ("skip", "d/n.md") and got["p3"] == ("skip", "d/n.md") and got["p4"] == ("move", "d/m.md")
    assert got["p2"][0] == "move" and got["p2"][1].startswith("d/n-") and len(got["p2"][1]) == len("d/n-12345678.md")


def test_sessions(spark):
    sessions = spark.createDataFrame([("url", "HTTPS://H/O/W.git", None), ("cwd", None, "/home/W"), ("leaf", None, "/x/my-w-dir/a"), ("no", "other", None), ("bare", None, None)], "session_id string, repository string, cwd string")
    repos = spark.createDataFrame([("r", "https://h/o/w.git", "/home/my-w-dir")], "repo string, origin_url string, root string")
    assert {r.session_id for r in consolidate.match_sessions(sessions, repos).collect()} == {"url", "leaf"}


def test_manifest_order(spark):
    rows = [("r", None, None, "move", "t", "b", "x", [2, 1], None), ("r", "2024-01-02", None, "move", "t", "c", "x", [], None), ("r", "2023-01-02", None, "skip", "t", "z", None, [7], "n")]
    df = spark.createDataFrame(rows, "repo string, date string, timestamp string, action string, type string, source string, destination string, issues array<int>, note string")
    assert [(r.source, r.issues) for r in consolidate.manifest(df).collect()] == [("z", "#7"), ("c", ""), ("b", "#2 #1")]


def test_worktree_safety(spark):
    rows = [("r", "C:\\w\\app", "c:/W/App/.worktrees/x/"), ("r", "C:\\w\\app", "C:/w/app/.worktrees"), ("r", "C:\\w\\app", "C:/w/app/.worktreesX"), ("r", "C:\\w\\app", "D:/copilot-worktrees/APP/s"), ("r", "C:\\w\\app", "D:/copilot-worktrees/app/t"), ("r", "C:\\w\\app", ""), ("r", "C:\\w\\app", "D:/copilot-worktrees/other/s")]
    registered = spark.createDataFrame([("r", "d:\\Copilot-Worktrees\\app\\s\\"), ("r", "D:/copilot-worktrees/other/s")], "repo string, path string")
    got = {r.path: r.safe for r in cleanup.worktree_safe(spark.createDataFrame(rows, "repo string, root string, path string"), registered).collect()}
    assert {p for p, s in got.items() if s} == {rows[0][2], rows[1][2], rows[3][2]}


def test_dirty_unknown_is_not_empty(spark):
    raw = spark.createDataFrame([("w1", 0, " M a"), ("w1", 1, "?? b"), ("w2", 0, "?? c"), ("w3", 0, " M d")], "worktree string, line_no int, line string")
    trees = spark.createDataFrame([("w1", True, True), ("w2", True, True), ("w3", True, False), ("w4", False, False)], "worktree string, on_disk boolean, status_ok boolean")
    got = {r.worktree: (r.tracked, r.untracked, r.unknown, r.action) for r in cleanup.dirty_state(dumps.parse_status(raw), trees).collect()}
    assert got == {"w1": ([" M a"], ["b"], False, "refuse"), "w2": ([], ["c"], False, "discard-untracked"), "w3": ([], [], True, "refuse"), "w4": ([], [], False, "none")}
    assert {r.action for r in cleanup.dirty_state(dumps.parse_status(raw), trees, dry_run=True).collect()} == {"report", "discard-untracked", "none"}
    assert {r.action for r in cleanup.dirty_state(dumps.parse_status(raw), trees, force=True).collect()} == {"proceed", "discard-untracked", "none"}


def test_accounting_order(spark):
    branches = spark.createDataFrame([("r", b, b != "lost") for b in ("anc", "patch", "merge", "none", "empty", "lost")], "repo string, branch string, resolvable boolean")
    commits = spark.createDataFrame([("r", "patch", "s1", 1, "p1"), ("r", "merge", "s2", 1, "p9"), ("r", "none", "s3", 1, "p1"), ("r", "none", "s4", 2, None), ("r", "lost", "s5", 1, "p1")], "repo string, branch string, sha string, seq long, patch_id string")
    integration = spark.createDataFrame([("r", "p1"), ("r", None)], "repo string, patch_id string")
    ancestors = branches.select("repo", "branch", (F.col("branch") == "anc").alias("is_ancestor"))
    merges = branches.select("repo", "branch", (F.col("branch") == "merge").alias("merged"))
    got = {r.branch: (r.check, r.missing) for r in cleanup.branch_accounting(branches, ancestors, cleanup.patch_equivalence(commits, integration), merges).collect()}
    assert {k: v[0] for k, v in got.items()} == {"anc": "ancestry", "patch": "patch", "merge": "merge", "none": None, "empty": None, "lost": None}
    assert got["none"][1] == ["s4"]


def test_dates_follow_long_chains_and_end_in_circles(spark):
    chain = [("r", f"p{i}", f"p{i - 1}" if i else None, i + 1, f"20{i % 25:02}-01-01") for i in range(200)]
    circle = [("r", "a", "b", 1, "2011-01-01"), ("r", "b", "a", 1, "2012-01-01"), ("r", "c", "gone", 1, "2013-01-01")]
    got = {r.path: r.author_date for r in consolidate.first_added(spark.createDataFrame(chain + circle, "repo string, path string, old_path string, seq int, author_date string")).collect()}
    assert {got[f"p{i}"] for i in range(200)} == {"2000-01-01"}
    assert (got["a"], got["b"], got["c"]) == ("2011-01-01", "2012-01-01", "2013-01-01")


def test_ancestry_of_a_long_line_with_a_merge(spark):
    line = [("r", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(300)]
    side = [("r", "s0", ["c5"]), ("r", "s1", ["s0"]), ("r", "top", ["c299", "s1"]), ("r", "other", ["c9"]), ("r", "x", ["y"]), ("r", "y", ["x"])]
    commits = spark.createDataFrame(line + side, "repo string, sha string, parent_shas array<string>")
    branches = spark.createDataFrame([("r", s, s) for s in ("c0", "c150", "s0", "s1", "top", "other", "x")], "repo string, branch string, tip_sha string")
    tips = spark.createDataFrame([("r", "top")], "repo string, tip_commit string")
    assert {r.branch for r in cleanup.ancestry(branches, commits, tips).where("is_ancestor").collect()} == {"c0", "c150", "s0", "s1", "top"}


def test_cleanup_gates_come_before_branches(spark):
    branches = spark.createDataFrame([("r", b, b != "main") for b in ("main", "anc", "patch", "none", "dirty", "har", "unknown", "lost")], "repo string, branch string, gone boolean")
    trees = spark.createDataFrame([("r", b, f"/w/{b}") for b in ("anc", "dirty", "har", "unknown", "orphan", "dirty-orphan")], "repo string, branch string, path string")
    told = [("r", "anc", True, "ancestry", None), ("r", "patch", True, "patch", None), ("r", "none", False, None, ["s4"])] + [("r", b, True, "ancestry", None) for b in ("dirty", "har", "unknown")]
    accounting = spark.createDataFrame(told, "repo string, branch string, accounted boolean, check string, missing array<string>")
    dirty = spark.createDataFrame([("r", f"/w/{b}", "dirty" in b) for b in ("anc", "dirty", "har", "orphan", "dirty-orphan")], "repo string, path string, at_risk boolean")
    captures = spark.createDataFrame([("r", "/w/har", 2)], "repo string, path string, n long")
    got = {r.branch: (r.outcome, r.missing) for r in cleanup.cleanup_plan(branches, trees, accounting, "main", dirty, captures).collect()}
    assert got == {
        "anc": ("delete -d", None), "patch": ("delete -D", None), "none": ("left-in-place", ["s4"]), "dirty": ("blocked-dirty", None), "har": ("blocked-captures", None),
        "unknown": ("blocked-dirty", None), "lost": ("absent", None), "orphan": ("orphan", None), "dirty-orphan": ("blocked-dirty", None),
    }
    forced = {r.branch: r.outcome for r in cleanup.cleanup_plan(branches, trees, accounting, "main", dirty, captures, force=True).collect()}
    assert forced["dirty"] == forced["none"] == "delete -D" and forced["har"] == "blocked-captures" and forced["dirty-orphan"] == "orphan"


def test_ancestry_walks_merges(spark):
    commits = spark.createDataFrame([("r", "m", ["a", "b"]), ("r", "a", ["0"]), ("r", "b", ["0"]), ("r", "0", []), ("r", "x", ["0"])], "repo string, sha string, parent_shas array<string>")
    branches = spark.createDataFrame([("r", s, s) for s in ("a", "b", "0", "x", "m")], "repo string, branch string, tip_sha string")
    tips = spark.createDataFrame([("r", "m")], "repo string, tip_commit string")
    assert {r.branch for r in cleanup.ancestry(branches, commits, tips).where("is_ancestor").collect()} == {"a", "b", "0", "m"}


def test_merge_needs_a_net_change(spark):
    base = spark.createDataFrame([("r", "f", "1"), ("q", "f", "1")], "repo string, path string, blob string")
    branch = spark.createDataFrame([("r", "f", "1"), ("q", "f", "2")], "repo string, path string, blob string")
    integration = spark.createDataFrame([("r", "f", "1"), ("q", "f", "2")], "repo string, path string, blob string")
    assert {r.repo: r.merged for r in cleanup.merge_changes_nothing(base, branch, integration).collect()} == {"r": False, "q": True}


def test_captures_and_links(spark):
    inventory = spark.createDataFrame([("r", "c/a.har", 2048, False), ("r", "c/d/session.json", 10, False), ("r", "c/l.har", 5, True), ("r", "e/b.har", 5, False), ("r", "c/x.txt", 5, False)], "repo string, path string, size long, is_link boolean")
    ignored = spark.createDataFrame([("r", "c/"), ("r", "c/d/session.json")], "repo string, path string")
    got = cleanup.capture_artifacts(ignored, inventory).first()
    assert (got.n, got.bytes, got["size"], got.folders) == (2, 2058, "2 KB", ["c", "c/d"])
    desired = spark.createDataFrame([("h", n, f"/k/s/{n}", n != "miss") for n in ("miss", "folder", "same", "moved", "new")], "home string, name string, source string, source_exists boolean")
    actual = spark.createDataFrame([("h", "folder", False, None, True), ("h", "same", True, "/k/s/same/", True), ("h", "moved", True, "/else", True), ("h", "old", True, "/k/s/old", False), ("h", "mine", True, "/z/mine", False), ("h", "miss", True, "/k/s/miss", False)], "home string, name string, is_link boolean, target string, target_exists boolean")
    found = sorted((r.name, r.status) for r in links.reconcile_links(desired, actual, ("/k/s/",)).collect())
    assert found == [("folder", "Skipped"), ("miss", "Missing"), ("miss", "Removed"), ("moved", "Linked"), ("new", "Linked"), ("old", "Removed"), ("same", "Unchanged")]


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def test_staleness(spark):
    rows = [("never", "p/a.cs", 1), ("newer", "p/a.cs", 5), ("newer", "p/bin/x/App.dll", 4), ("equal", "p/a.cs", 4), ("equal", "p/bin/App.dll", 4), ("obj", "p/obj/g.cs", 9), ("obj", "p/bin/APP.DLL", 4), ("two", "p/a.cs", 6), ("two", "p/bin/a/App.dll", 1), ("two", "p/bin/b/App.dll", 7)]
    inventory = spark.createDataFrame([(r, p, at(m)) for r, p, m in rows], "repo string, path string, mtime timestamp")
    projects = inventory.select("repo").distinct().selectExpr("repo", "'p/App.csproj' project", "'App' assembly")
    assert {r.repo: r.build_required for r in builds.build_staleness(projects, inventory).collect()} == {"never": True, "newer": True, "equal": False, "obj": False, "two": False}
    assert {r.repo: r.assembly_path for r in builds.newest_assembly(projects, inventory).collect()}["two"] == "p/bin/b/App.dll"


def test_launch_plans(spark):
    rows = [("ok", "p/a.csproj", 1), ("ok", "Directory.Build.props", 1), ("time", "p/a.csproj", 9), ("gone", "p/a.csproj", 1), ("old", "p/a.csproj", 1)]
    inventory = spark.createDataFrame([(r, p, at(m)) for r, p, m in rows], "repo string, path string, mtime timestamp")
    plans = spark.createDataFrame([("ok", "p/a.csproj", ["p/a.csproj", "Directory.Build.props"], at(2)), ("time", "p/a.csproj", ["p/a.csproj"], at(2)), ("gone", "p/a.csproj", ["p/a.csproj", "p/Directory.Build.props"], at(2)), ("old", "p/a.csproj", [], at(2))], "repo string, project string, input array<string>, mtime timestamp")
    assert {r.repo: r.current for r in builds.launch_plan_current(plans, inventory).collect()} == {"ok": True, "time": False, "gone": False, "old": False}


def test_tail_and_flags(spark):
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(["x", "  ", "\tlong line of text", "a: Fehler CS0168: y", "0 Warning(s)", "error NETSDK1004: z"])], "build_id string, line_no int, line string")
    assert [r.shown for r in builds.log_tail(df, n=4, width=12).orderBy("line_no").collect()] == ["long line...", "a: Fehler...", "0 Warning(s)", "error NET..."]
    flags = [(r.is_diagnostic, r.is_restore_failure) for r in builds.build_log_flags(df).orderBy("line_no").collect()]
    assert flags == [(False, False), (False, False), (False, False), (True, False), (False, False), (True, True)]


def test_suite_verdict_names_missing_files(spark):
    runs = spark.createDataFrame([("ok", 3, 0, "Passed"), ("none", None, None, None), ("zero", 0, 0, "Passed"), ("bad", 3, 1, "Failed"), ("odd", 3, 0, "Failed"), ("lost", 3, 0, "Passed")], "run_id string, total int, failed int, result string")
    names = ("ok", "none", "zero", "bad", "odd", "lost", "thrown")
    expected = spark.createDataFrame([(r, f) for r in names for f in ("b", "a", "a")], "run_id string, file string")
    seen = spark.createDataFrame([(r, f) for r in names for f in ("a", "b", "more") if (r, f) not in {("lost", "a"), ("thrown", "a"), ("thrown", "b")}], "run_id string, file string")
    got = {r.run_id: (r.reasons, r.missing) for r in builds.suite_verdict(runs, expected, seen).collect()}
    assert got == {
        "ok": ([], []), "none": (["no-result"], []), "zero": (["no-tests"], []), "bad": (["failed", "not-passed"], []), "odd": (["not-passed"], []),
        "lost": (["missing-files"], ["a"]), "thrown": (["no-result", "missing-files"], ["a", "b"]),
    }


def test_suite_verdict_takes_files_by_aggregation(spark):
    """The files of both sides are one aggregation and meet in no join; names that are null are equal to none."""
    runs = spark.createDataFrame([("r", 3, 0, "Passed"), ("only", 1, 0, "Passed")], "run_id string, total int, failed int, result string")
    expected = spark.createDataFrame([("r", "a"), ("r", None), ("x", "b")], "run_id string, file string")
    got = builds.suite_verdict(runs, expected, expected)
    assert {r.run_id: (r.reasons, r.missing) for r in got.collect()} == {"r": (["missing-files"], []), "only": ([], []), "x": (["no-result"], [])}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) == 1


def test_totals_tell_why_nothing_moves(spark):
    ops = spark.createDataFrame([("r", "A", "a", None), ("r", "A", "b", None), ("r", "D", "c", None)], "repo string, op string, path string, old_path string")
    repos = spark.createDataFrame([("r", "v1", "v2"), ("same", "v2", "v2"), ("moved", "v1", "v2"), ("unknown", None, None)], "repo string, anchor_label string, tip_label string")
    got = {(r.repo, r.op): (r.n, r.verdict) for r in snapshots.op_totals(ops, repos).collect()}
    assert got == {("r", "A"): (2, "syncing"), ("r", "D"): (1, "syncing"), ("r", None): (3, "syncing"), ("same", None): (0, "at-head"), ("moved", None): (0, "moved"), ("unknown", None): (0, "moved")}
    assert {r.verdict for r in snapshots.op_totals(ops.limit(0), repos).collect()} == {"at-head", "moved"}


def test_dates_of_names_that_are_used_again(spark):
    """A rename is followed as of its time: not into what its names held before or hold later."""
    rows = [
        ("a", None, 1, "2001"), ("b", None, 2, "2002"), ("b", "a", 5, "2005"),  # b held another file before
        ("a", None, 7, "2007"), ("c", "a", 9, "2009"), ("d", "b", 8, "2008"),  # a is used again, and that one goes to c
        ("b", None, 10, "2010"), ("e", "gone", 3, "2003"), ("f", "f", 4, "2004"), ("g", "e", 3, "2003b"),
    ]
    files = spark.createDataFrame([("r", *x) for x in rows], "repo string, path string, old_path string, seq int, author_date string")
    got = {r.path: r.author_date for r in consolidate.first_added(files).collect()}
    assert got == {"a": "2001", "b": "2001", "c": "2001", "d": "2001", "e": "2003", "f": "2004", "g": "2003b"}


def test_manifest_is_written_again_by_repository(spark, tmp_path):
    schema = "repo string, date string, timestamp string, action string, type string, source string, destination string, issues array<int>, note string"
    row = lambda repo, date, source: (repo, date, None, "move", "t", source, "d", [1, 2], None)
    path = (tmp_path / "manifest").as_uri()
    consolidate.write_manifest(spark.createDataFrame([row("r", None, "z"), row("r", "2024", "b"), row("r", "2023", "c"), row("q", "2020", "a")], schema), path)
    consolidate.write_manifest(spark.createDataFrame([row("q", "2021", "n")], schema), path)
    got = consolidate.read_manifest(spark, path)
    assert sorted((r.repo, r.date, r.source, r.issues) for r in got.collect() if r.date) == [("q", "2021", "n", "#1 #2"), ("r", "2023", "c", "#1 #2"), ("r", "2024", "b", "#1 #2")]
    # One file here: its rows are in order.
    assert [r.source for r in spark.read.parquet(f"{path}/repo=r").coalesce(1).collect()] == ["c", "b", "z"]


def test_prompts(spark):
    rows = [(7, "Fix\nthis", " a\r\nb "), (7, "", ""), (None, " do it ", None), (None, "", None)]
    got = [(r.name, r.prompt) for r in consolidate.issue_prompts(spark.createDataFrame(rows, "number int, title string, context string")).collect()]
    assert got[0] == ("7: Fix this", "@dev-loop gh issue 7: Fix this\n\na\nb")
    assert got[1] == ("7:", "@dev-loop gh issue 7")
    assert got[2][0] == "new: do it" and got[3][0] == "new issue"


def test_file_cleanup(spark):
    candidates = spark.createDataFrame([("r", "t", " M", "1", "tip"), ("r", "p", " M", "2", "old"), ("r", "u", "??", "2", "old"), ("r", "l", "??", "3", "mine"), ("r", "n", "??", "3", "mine"), ("r", "c", "A ", "1", "tip")], "repo string, path string, xy string, blob string, content string")
    tip = spark.createDataFrame([("r", p, "1") for p in "tpulc"], "repo string, path string, blob string")
    history = spark.createDataFrame([("r", p, "old") for p in "tpul"], "repo string, path string, content string")
    got = {r.path: r.decision for r in plan.worktree_file_cleanup(candidates, tip, history).collect()}
    assert got == {"t": "revert", "p": "keep-pin", "u": "delete", "l": "keep-local"}


def test_stream_tails_go_on_where_they_stopped(spark, tmp_path):
    """Two calls on one folder, with lines that come late and files that come in between, equal one look at all lines."""
    source, folder = tmp_path / "in", (tmp_path / "out").as_uri()
    schema = "build_id string, line_no int, line string"
    before = {k: spark.conf.get(k, None) for k in build_logs.SETTINGS}

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))

    def tails():
        got = build_logs.latest_tails(spark, lambda own: own.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), folder)
        return {r.build_id: (r.n_lines, r.tail.split("\n")) for r in got.collect()}

    all_lines = [(f"b{b}", i, f"line {i}" if i % 5 else " ") for b in range(3) for i in range(30)]
    arrive([r for r in all_lines if r[1] % 3 == 2])
    first = tails()
    assert first["b1"] == (8, [f"line {i}" for i in (2, 8, 11, 14, 17, 23, 26, 29)])
    assert tails() == first, "nothing new"
    arrive([r for r in all_lines if r[1] % 3 == 0])
    arrive([r for r in all_lines if r[1] % 3 == 1] + [("new", 1, "only")])
    want = {f"b{b}": (24, [f"line {i}" for i in range(30) if i % 5][-10:]) for b in range(3)}
    assert tails() == want | {"new": (1, ["only"])}
    # A batch that is done again replaces what it wrote.
    spark.read.parquet(f"{folder}/updates/batch=1").write.mode("overwrite").parquet(f"{folder}/again")
    spark.read.parquet(f"{folder}/again").write.mode("overwrite").parquet(f"{folder}/updates/batch=1")
    assert tails()["b0"] == want["b0"]
    assert {k: spark.conf.get(k, None) for k in build_logs.SETTINGS} == before


def test_runs_of_a_build_are_put_together(spark, tmp_path, monkeypatch):
    """State that went between two calls begins a new run; its lines and the older ones make one tail."""
    monkeypatch.setattr(build_logs, "KEPT_MS", 1)
    source, folder = str(tmp_path / "in"), (tmp_path / "out").as_uri()
    schema = "build_id string, line_no int, line string"
    for part in range(2):
        spark.createDataFrame([("b", part * 8 + i, f"l{part * 8 + i}") for i in range(8)], schema).coalesce(1).write.mode("append").json(source)
        got = build_logs.latest_tails(spark, lambda own: own.readStream.schema(schema).json(source), folder)
    row = got.collect()[0]
    assert (row.n_lines, row.tail.split("\n")) == (16, [f"l{i}" for i in range(6, 16)])


def test_greedy_pairs_hold_no_repository_in_one_python_group(spark):
    rows = [("r", f"o{i}", f"n{j}", ((i * 7 + j * 3) % 5) / 4) for i in range(5) for j in range(4)]
    pairs = snapshots.greedy_pairs(spark.createDataFrame(rows, "repo string, old_path string, path string, score double"))
    want, old, new = set(), set(), set()
    for r, o, n, _ in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if o not in old and n not in new:
            want.add((r, o, n))
            old.add(o)
            new.add(n)
    assert {tuple(r) for r in pairs.collect()} == want
    assert "Pandas" not in pairs._jdf.queryExecution().toString()
