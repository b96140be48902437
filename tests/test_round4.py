"""Findings of round 3: sizes and shapes that the small tables lack."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from convoy.functions.text import human_size
from convoy.operators import ancestry
from convoy.sources import readers, views


def test_sizes_up_to_the_largest_unit(spark):
    df = spark.createDataFrame([(n,) for n in (1023, 1536, 2560, (1 << 20) - 1, 1 << 20, 5 << 30)], "n long")
    assert [r[0] for r in df.select(human_size(F.col("n"), "KB")).collect()] == ["1023 bytes", "2 KB", "2 KB", "1,024 KB", "1,024 KB", "5,242,880 KB"]
    assert [r[0] for r in df.select(human_size(F.col("n"))).collect()][3:] == ["1,024 KB", "1.0 MB", "5.00 GB"]


def test_small_dumps_share_files(spark, tmp_path):
    """Three hundred repositories are few files; a repository's newest dump counts, whether it is packed or in a folder."""
    path, schema = (tmp_path / "dumps").as_uri(), "repo string, line_no int, line string"
    rows = [(f"r{i}", n, f"line\t{n} of {i}") for i in range(300) for n in (1, 2)] + [("tab\there", 1, "a"), ("50%25", 1, ""), ("%", 1, "p"), (None, 1, "none")]
    told = lambda source="refs": sorted(map(repr, ((r.repo, r.line_no, r.line) for r in readers.read_dump(spark, path, source).collect())))
    readers.write_dump(spark.createDataFrame(rows, schema), path, "refs")
    assert told() == sorted(map(repr, rows))
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "dumps")) < 100
    assert told("status") == []
    # r1 is written again, r2 grows into a folder and shrinks again, one folder comes from elsewhere.
    rows = [r for r in rows if r[0] not in ("r1", "r2")]
    readers.write_dump(spark.createDataFrame([("r1", 5, "new")], schema), path, "refs")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30")
        readers.write_dump(spark.createDataFrame([("r2", n, f"a longer line {n}") for n in range(9)], schema), path, "refs")
        assert os.path.isdir(tmp_path / "dumps/repo=r2")
        assert told() == sorted(map(repr, [*rows, ("r1", 1, "new"), *(("r2", n + 1, f"a longer line {n}") for n in range(9))]))
        readers.write_dump(spark.createDataFrame([("r2", 1, "short")], schema), path, "refs")
        (tmp_path / "dumps/repo=ext/source=refs").mkdir(parents=True)
        (tmp_path / "dumps/repo=ext/source=refs/dump.txt").write_text("x\ny\n")
        assert told() == sorted(map(repr, [*rows, ("r1", 1, "new"), ("r2", 1, "short"), ("ext", 1, "x"), ("ext", 2, "y")]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_view_looks_at_all_later_rows_for_each_row(spark):
    """Spark's own text of the order graph has no such frame, and the rows of the shared text."""
    assert "UNBOUNDED FOLLOWING" not in " ".join(views.SPARK_VIEWS.values())
    d = "/root/testdata/sf0.001"
    shared = spark.sql(f"WITH orders AS (SELECT * FROM parquet.`{d}/orders.parquet`) {views.VIEWS['order_graph']}")
    own = views.view(spark, d, "order_graph")
    assert own.count() == shared.count() and own.exceptAll(shared).isEmpty()


def test_blocks_in_any_order_give_the_same_ancestry(spark):
    """Lines in order and in none, over many blocks, with a commit told twice: places hold, and a dump in order leaves few commits to joins."""
    line = [("r", f"m{i}", [f"m{i - 1}"] if i else []) for i in range(200)]
    side = [("r", f"a{i}-{k}", [f"a{i}-{k - 1}" if k else f"m{i}"]) for i in range(0, 190, 3) for k in range(3)]
    rows = line + side + [line[7]]
    random.Random(5).shuffle(rows)
    schema = "repo string, sha string, parent_shas array<string>"
    for df in (spark.createDataFrame(rows, schema).repartition(16), spark.createDataFrame(line + side, schema).coalesce(1)):
        past = ancestry.history(df)
        places = {r.sha: (r.chain, r.place) for r in past.places.collect()}
        assert past.places.count() == len(places) == len(line) + len(side)
        assert len({places[f"m{i}"][0] for i in range(200)}) == 1
        assert [places[f"m{i}"][1] - places["m0"][1] for i in range(200)] == list(range(200))
        known = ancestry.reached(past, spark.createDataFrame([("r", "a30-2")], "repo string, tip_commit string"))
        branches = spark.createDataFrame([("r", s, s) for _, s, _ in line + side], "repo string, branch string, tip_sha string")
        told = {r.branch for r in ancestry.contained(past, branches, known).where("is_ancestor").collect()}
        assert told == {f"m{i}" for i in range(31)} | {f"a30-{k}" for k in range(3)}
