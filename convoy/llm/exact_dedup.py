"""Exact dedup: group by a 128-bit content hash and compare the bytes inside each group.

The aggregation's key is (MD5, text): rows meet by hash, and within a hash only equal bytes
form a group, so two texts that share a hash stay apart. Spark combines equal texts before
the shuffle, so a text that a third of all rows share crosses it once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the white space that the contract names.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return one row per row of docs: id, keep_id, group_size, kept, text_sha256.

    The smallest id of each group of equal normalised texts stays. Null and empty texts are
    one group. Rows that repeat an id with the same text are members like any other, and
    `kept` is true for each that carries the smallest id. A row without an id is kept only
    if its whole group has none. Other columns are ignored.
    """
    # One narrow row per document; its text is hashed where it was read.
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_text"))
    hashed = rows.select("_id", F.unhex(F.md5("_text")).alias("_h"), "_text")
    groups = hashed.groupBy("_h", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The second digest tells colliding groups of one hash apart when rows look up their group.
    found = groups.select("_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    return (
        hashed.select("_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"))
        .join(found, ["_h", "_sha"])
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without exact copies, all columns kept. Of rows that repeat an id with one text, one stays."""
    names, norm = docs.columns, "__convoy_norm"
    hashed = docs.select("*", normalised(text_col).alias(norm))
    first = F.min_by(F.struct(*[F.col(c) for c in names]), F.struct(F.col(id_col).isNull(), F.col(id_col)))
    kept = hashed.groupBy(F.md5(norm).alias("_h"), norm).agg(first.alias("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])
