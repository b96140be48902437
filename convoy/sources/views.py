"""Deterministic tables of fleet data, derived by SQL from the star schema and the documents.

The same text runs in Spark and in any ANSI engine, so a query and its oracle read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A file of the commit graph has so many lines, each with the number of the commit that wrote it.
LINES = range(8)
_VERSIONS = ", ".join(f"coalesce(max(CASE WHEN own AND line = {j} THEN k END) OVER (PARTITION BY repo, f ORDER BY k), 0) AS v{j}" for j in LINES)
_TOUCHED = ", ".join(f"max(CASE WHEN l_suppkey % 8 = {j} THEN 1 ELSE 0 END) AS e{j}" for j in LINES)
# Every fourth branch brings what main has in the end, the others lines of their own.
_EDITED = ", ".join(f"CASE WHEN coalesce(s.e{j}, 0) = 0 THEN b.v{j} WHEN e.k % 4 = 0 THEN t.v{j} ELSE -e.k END AS v{j}" for j in LINES)
_CONTENT = "concat(" + ", chr(10), ".join(f"'line {j} of ', CAST(f AS STRING), ' by ', CAST(v{j} AS STRING)" for j in LINES) + ")"

#: In order: a view uses tables and views above it only.
VIEWS: dict[str, str] = {
    "base_docs": r"""SELECT doc_id, source AS repo, text,
 concat(CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '.github/agents/' WHEN 1 THEN '.github/skills/' WHEN 2 THEN 'docs/specs/' WHEN 3 THEN '.github/skills/own-x/' WHEN 4 THEN '.github/ci/tests/' ELSE 'src/' END, 'd', CAST(doc_id AS STRING), CASE WHEN doc_id % 12 = 3 THEN '.template' ELSE '.md' END) AS path
FROM documents""",
    "anchor_files": r"""SELECT repo, path, doc_id, sha1(text) AS blob, text AS content FROM base_docs WHERE doc_id % 11 <> 0""",
    "tip_files": r"""SELECT repo, CASE WHEN doc_id % 19 = 0 THEN concat('.github/agents/moved-', CAST(doc_id AS STRING), '.md') ELSE path END AS path, doc_id,
 sha1(CASE WHEN doc_id % 13 = 0 THEN concat(text, chr(10), 'upstream edit') ELSE text END) AS blob,
 CASE WHEN doc_id % 13 = 0 THEN concat(text, chr(10), 'upstream edit') ELSE text END AS content
FROM base_docs WHERE doc_id % 17 <> 0""",
    "history_files": r"""SELECT repo, path, 1 AS seq, sha1(concat('old ', text)) AS blob, concat('old ', text) AS content FROM base_docs UNION ALL SELECT repo, path, 2, blob, content FROM anchor_files UNION ALL SELECT repo, path, 3, blob, content FROM tip_files""",
    "head_files": r"""SELECT repo, path, doc_id, sha1(content) AS blob, content FROM (SELECT repo, path, doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, chr(10), concat(chr(13), chr(10))) WHEN doc_id % 23 = 0 THEN concat(text, chr(10), 'local edit') WHEN doc_id % 31 = 0 THEN concat('old ', text) ELSE text END AS content FROM base_docs WHERE doc_id % 29 <> 0) t""",
    "branch_commits": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, concat('feat/', CAST(o_orderkey AS STRING)) AS branch, sha1(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))) AS sha, l_linenumber AS seq, CAST(l_partkey % 400 AS STRING) AS patch_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 0""",
    "integration_commits": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, sha1(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))) AS sha, l_linenumber AS seq, CAST(l_partkey % 400 AS STRING) AS patch_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0""",
    # A commit graph: main lines, branches that leave them, take them in and are taken in.
    "order_graph": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, o_orderkey AS k, o_orderkey % 10 = 0 AS is_main, lag(o_orderkey) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS before_k,
 max(CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fork_k,
 min(CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_k,
 max(CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey % 20) AS tip_k FROM orders""",
    "branch_steps": r"""SELECT g.repo, g.k, concat('feat/', CAST(g.k AS STRING)) AS branch, g.fork_k, g.next_k, g.tip_k, row_number() OVER (PARTITION BY g.k ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY g.k) AS steps, l_partkey, l_suppkey FROM order_graph g JOIN lineitem ON g.k = l_orderkey WHERE NOT g.is_main""",
    "branch_ends": r"""SELECT repo, k, branch, tip_k, concat('b', CAST(k AS STRING), '-', CAST(steps AS STRING)) AS tip_sha, CASE WHEN k % 7 = 1 AND steps >= 3 AND next_k IS NOT NULL THEN next_k ELSE fork_k END AS base_k FROM branch_steps WHERE n = 1""",
    "graph_commits": r"""SELECT g.repo, concat('m', CAST(g.k AS STRING)) AS sha, CASE WHEN g.fork_k IS NOT NULL THEN concat('m', CAST(g.fork_k AS STRING)) END AS p1, CASE WHEN g.fork_k IS NOT NULL AND g.k % 30 = 0 AND g.before_k % 7 <> 1 THEN e.tip_sha END AS p2, CAST(CAST(floor(g.k / 10) AS BIGINT) % 400 AS STRING) AS patch_id, g.k AS seq FROM order_graph g LEFT JOIN branch_ends e ON e.repo = g.repo AND e.k = g.before_k WHERE g.is_main
UNION ALL SELECT repo, concat('b', CAST(k AS STRING), '-', CAST(n AS STRING)), CASE WHEN n > 1 THEN concat('b', CAST(k AS STRING), '-', CAST(n - 1 AS STRING)) WHEN fork_k IS NOT NULL THEN concat('m', CAST(fork_k AS STRING)) END, CASE WHEN k % 7 = 1 AND n = 3 AND next_k IS NOT NULL THEN concat('m', CAST(next_k AS STRING)) END, CAST(l_partkey % 400 AS STRING), n FROM branch_steps""",
    "main_lines": f"""SELECT repo, k, concat('m', CAST(k AS STRING)) AS sha, f, {_VERSIONS} FROM (SELECT repo, k, f, CAST(floor(k / 10) AS BIGINT) % 3 = f AS own, CAST(floor(k / 30) AS BIGINT) % 8 AS line FROM order_graph CROSS JOIN (VALUES (0), (1), (2)) AS t(f) WHERE is_main) x""",
    "branch_lines": f"""SELECT e.repo, e.k, e.tip_sha AS sha, b.f, {_EDITED} FROM branch_ends e JOIN main_lines b ON b.repo = e.repo AND b.k = e.base_k JOIN main_lines t ON t.repo = e.repo AND t.k = e.tip_k AND t.f = b.f
 LEFT JOIN (SELECT k, l_partkey % 3 AS f, {_TOUCHED} FROM branch_steps WHERE NOT (k % 7 = 1 AND n = 3) GROUP BY k, l_partkey % 3) s ON s.k = e.k AND s.f = b.f""",
    "graph_trees": f"""SELECT repo, sha, path, sha1(content) AS blob, content FROM (SELECT repo, sha, concat('src/f', CAST(f AS STRING)) AS path, {_CONTENT} AS content FROM (SELECT * FROM main_lines UNION ALL SELECT * FROM branch_lines) l) c""",
    "remotes": r"""SELECT c_custkey AS repo_id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat('https://github.com/Org', CAST(c_nationkey AS STRING), '/Repo', CAST(c_custkey % 50 AS STRING), '.git') WHEN 1 THEN concat('git@github.com:org', CAST(c_nationkey AS STRING), '/repo', CAST(c_custkey % 50 AS STRING)) WHEN 2 THEN concat('ssh://git@ssh.github.com/org', CAST(c_nationkey AS STRING), '/repo', CAST(c_custkey % 50 AS STRING), '.git/') WHEN 3 THEN 'https://gitlab.com/o/r.git' WHEN 4 THEN concat('C:', chr(92), 'git', chr(92), 'R', CAST(c_custkey % 50 AS STRING), '.git') ELSE '' END AS origin_url FROM customer""",
    "build_lines": r"""SELECT user_id AS build_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, ts, CASE event_type WHEN 'error' THEN concat('P.cs(1,1): error CS', lpad(CAST(event_id % 10000 AS STRING), 4, '0'), ': boom') WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'error NETSDK1004: Assets file not found.' ELSE 'P.cs(1,5): Warnung CS0168: x' END WHEN 'view' THEN '   ' WHEN 'click' THEN '    0 Warning(s)' ELSE 'Build succeeded.' END AS line FROM events""",
    "inventory": r"""SELECT CAST(user_id AS STRING) AS repo, path, max(ts) AS mtime, max(event_id) AS size FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN concat('src/App/A', CAST(event_id % 20 AS STRING), '.cs') WHEN 'view' THEN 'src/App/obj/Gen.cs' WHEN 'purchase' THEN 'src/App/bin/Debug/App.dll' WHEN 'error' THEN 'src/App/App.csproj' ELSE CASE WHEN event_id % 2 = 0 THEN 'NuGet.Config' ELSE concat('.har-captures/s', CAST(event_id % 5 AS STRING), '.har') END END AS path FROM events) t GROUP BY user_id, path""",
    "status_lines": r"""SELECT concat('w', CAST(l_suppkey AS STRING)) AS worktree, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS INT) AS line_no, concat(CASE l_returnflag WHEN 'R' THEN ' M' WHEN 'A' THEN '??' ELSE CASE WHEN l_linenumber = 1 THEN 'A ' ELSE '!!' END END, ' ', CASE WHEN l_partkey % 5 = 0 THEN concat(chr(34), 'a b', CAST(l_partkey AS STRING), chr(34)) ELSE concat('f', CAST(l_partkey AS STRING)) END) AS line FROM lineitem WHERE l_suppkey % 4 <> 0""",
    "issue_docs": r"""SELECT conv_id, turn, concat(text, CASE CAST(turn % 4 AS INT) WHEN 0 THEN concat(' Closes #', CAST(conv_id AS STRING)) WHEN 1 THEN concat(' see #', CAST(turn AS STRING), ' and #', CAST(conv_id AS STRING), '.') WHEN 2 THEN concat(' abc#', CAST(conv_id AS STRING)) ELSE concat(' fixes #', CAST(conv_id AS STRING), 'x') END) AS text FROM conversations""",
    "spec_sources": r"""SELECT source AS repo, concat('tasks/', CASE WHEN doc_id % 3 = 0 THEN concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '-') ELSE '' END, 'n', CAST(doc_id % 40 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '-plan' ELSE '-prd' END, '.md') AS path, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'same' ELSE text END AS content FROM documents""",
    "ignore_upstream_lines": r"""SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, CASE event_type WHEN 'click' THEN concat('dir', CAST(event_id % 30 AS STRING), '/') WHEN 'view' THEN '' WHEN 'error' THEN '# note' WHEN 'purchase' THEN concat('  f', CAST(event_id % 40 AS STRING), ' ') ELSE CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '# >>> upstream-only >>>' WHEN 1 THEN '# <<< UPSTREAM-only <<<' ELSE concat('*.x', CAST(event_id % 10 AS STRING)) END END AS line FROM events""",
    "ignore_local_lines": r"""SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, CASE event_type WHEN 'click' THEN concat('dir', CAST(event_id % 30 AS STRING), '/') WHEN 'purchase' THEN concat('f', CAST(event_id % 40 AS STRING)) ELSE '# local' END AS line FROM events WHERE event_id % 3 = 0""",
    "name_status_lines": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, o_orderkey AS line_no, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat('A', chr(9), 'f', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('M070', chr(9), 'CLAUDE.md') WHEN 2 THEN concat('D', chr(9), '.github/agents/x', CAST(o_orderkey AS STRING)) WHEN 3 THEN concat('R095', chr(9), 'old', CAST(o_orderkey AS STRING), chr(9), 'new', CAST(o_orderkey AS STRING)) WHEN 4 THEN concat('C100', chr(9), 'src', chr(9), 'dst') WHEN 5 THEN concat('R100', chr(9), 'only-one') WHEN 6 THEN concat('X', chr(9), 'odd') ELSE '' END AS line FROM orders""",
    "worktree_lines": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, o_orderkey * 4 AS line_no, concat('worktree /w/', CAST(o_orderkey AS STRING)) AS line FROM orders UNION ALL SELECT concat('r', CAST(o_custkey % 20 AS STRING)), o_orderkey * 4 + 1, concat('branch refs/heads/feat/', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT concat('r', CAST(o_custkey % 20 AS STRING)), o_orderkey * 4 + 2, 'locked because' FROM orders WHERE o_orderkey % 7 = 0""",
    "ref_lines": r"""SELECT concat('r', CAST(o_custkey % 20 AS STRING)) AS repo, concat('feat/', CAST(o_orderkey AS STRING), ' ', CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '[gone]' WHEN 1 THEN '[ahead 1]' ELSE '' END) AS line FROM orders WHERE o_orderkey % 9 <> 0""",
    "ls_remote_lines": r"""SELECT c_custkey AS repo_id, concat(sha1(c_name), chr(9), CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'refs/heads/Main' WHEN 2 THEN 'refs/heads/release/main' ELSE 'refs/tags/main' END, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE '' END) AS line FROM customer""",
    # Names are used before, taken by a rename, and used again.
    "commit_files": r"""SELECT concat('r', CAST(p_partkey % 7 AS STRING)) AS repo, path, old_path, seq, author_date, concat(sha, CAST(p_partkey AS STRING)) AS sha, concat('work on ', path, ' at ', CAST(seq AS STRING)) AS subject FROM (
SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-0') AS path, CAST(NULL AS STRING) AS old_path, 10 AS seq, '2020-01-01' AS author_date, 'aaaaaa' AS sha FROM part
UNION ALL SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-1'), CAST(NULL AS STRING), 5, '2019-05-05', 'dddddd' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-1'), concat('p', CAST(p_partkey AS STRING), '-0'), 20, '2022-02-02', 'bbbbbb' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-2'), concat('p', CAST(p_partkey AS STRING), '-1'), 30, '2024-03-03', 'cccccc' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-1'), concat('p', CAST(p_partkey + 7 AS STRING), '-0'), 40, '2025-04-04', 'eeeeee' FROM part WHERE p_partkey % 8 = 0
UNION ALL SELECT p_partkey, concat('p', CAST(p_partkey AS STRING), '-0'), concat('p', CAST(p_partkey AS STRING), '-1'), 50, '2026-05-05', 'ffffff' FROM part WHERE p_partkey % 5 = 0) e""",
    "sessions": r"""SELECT conv_id AS session_id, CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN concat('https://github.com/Acme/Widget', CAST(conv_id % 10 AS STRING), '.git') WHEN 1 THEN CAST(NULL AS STRING) ELSE 'other' END AS repository, CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN concat('/home/u/WIDGET', CAST(conv_id % 10 AS STRING)) WHEN 1 THEN concat('/x/widget', CAST(conv_id % 10 AS STRING), '/sub') ELSE CAST(NULL AS STRING) END AS cwd FROM conversations GROUP BY conv_id""",
    "project_files": r"""SELECT concat('r', CAST(p_partkey % 20 AS STRING)) AS repo, concat('src/P', CAST(p_partkey AS STRING), '/P', CAST(p_partkey AS STRING), '.csproj') AS path, concat('<Project>', CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '<OutputType> Exe </OutputType>' WHEN 1 THEN '<outputtype>WinExe</outputtype>' WHEN 2 THEN '<OutputType>Library</OutputType>' ELSE '' END, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN concat('<AssemblyName> asm', CAST(p_partkey AS STRING), ' </AssemblyName>') WHEN 1 THEN '<AssemblyName>$(X)</AssemblyName>' ELSE '' END, '</Project>') AS content FROM part""",
    "managed_texts": r"""SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN text WHEN 2 THEN concat(text, chr(10), '<!-- BEGIN -->', chr(10), 'old', chr(10), '<!-- END -->', chr(10)) WHEN 3 THEN concat('<!-- BEGIN -->', chr(13), chr(10), 'new', chr(13), chr(10), '<!-- END -->') WHEN 4 THEN concat('<!-- END -->', text, '<!-- BEGIN -->') ELSE concat(text, '<!-- BEGIN -->') END AS text FROM documents""",
    "link_desired": r"""SELECT concat('h', CAST(p_partkey % 50 AS STRING)) AS home, concat('skill', CAST(p_partkey AS STRING)) AS name, concat('/clone/skills/skill', CAST(p_partkey AS STRING)) AS source, p_partkey % 11 <> 0 AS source_exists FROM part WHERE p_partkey % 13 <> 0""",
    "link_actual": r"""SELECT concat('h', CAST(p_partkey % 50 AS STRING)) AS home, concat('skill', CAST(p_partkey AS STRING)) AS name, p_size % 5 <> 0 AS is_link, concat(CASE WHEN p_partkey % 3 = 0 THEN '/elsewhere/' ELSE '/clone/skills/' END, 'skill', CAST(p_partkey AS STRING)) AS target, p_partkey % 13 <> 0 OR p_size % 2 = 0 AS target_exists FROM part WHERE p_size % 4 <> 0""",
    "test_files": r"""SELECT o_orderkey AS run_id, l_linenumber AS file_no, l_returnflag <> 'R' AS has_container, CAST(l_quantity AS INT) AS total, CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS failed FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 20 <> 0""",
}

#: Views that Spark derives by another text with the same rows: a frame of what follows looks at every later row again for each row, so
#: its time is the square of a partition's rows; the same frame in descending order is what precedes and costs one step a row.
SPARK_VIEWS: dict[str, str] = VIEWS | {"order_graph": VIEWS["order_graph"].replace("ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING", "ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")}


def needed(sql: str) -> list[str]:
    """Views that sql uses, also through others, in order."""
    found: set[str] = set()
    words = set(re.findall(r"\w+", sql))
    for name in reversed(VIEWS):
        if name in words:
            found.add(name)
            words |= set(re.findall(r"\w+", VIEWS[name]))
    return [name for name in VIEWS if name in found]


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """sql with the views it uses as common table expressions."""
    parts = ", ".join(f"{name} AS ({views[name]})" for name in needed(sql))
    if not parts:
        return sql
    body = sql.strip()
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, over the Parquet files of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows(spark, sf_dir, f"SELECT * FROM {name}")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of sql over views and tables."""
    text = with_views(sql, SPARK_VIEWS)
    words = set(re.findall(r"\w+", text))
    tables = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if t in words)
    return spark.sql(f"WITH {tables}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {tables} {text}")
