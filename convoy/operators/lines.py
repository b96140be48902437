"""Ordered line work: chunks, marker blocks, union merges, managed blocks. Order is an explicit line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convoy.functions.text import eol_normalize, trimmed


def ignore_chunks(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """lines without blanks, with chunk_id (from 1, ascending, not dense) and kind (comment, entry).

    A chunk ends at a blank line, and before a comment that follows an entry.
    """
    text = trimmed(F.col("line"))
    order = W.partitionBy(key).orderBy("line_no")
    kind = F.when(text == "", "blank").when(text.startswith("#"), "comment").otherwise("entry")
    marked = lines.withColumn("kind", kind).withColumn("_before", F.lag("kind").over(order))
    starts = F.col("_before").isNull() | (F.col("kind") == "blank") | ((F.col("kind") == "comment") & (F.col("_before") == "entry"))
    numbered = marked.withColumn("chunk_id", F.sum(starts.cast("int")).over(order))
    return numbered.where("kind <> 'blank'").drop("_before")


def strip_marker_blocks(lines: DataFrame, opens: str, closes: str, key: str = "file_id") -> DataFrame:
    """lines outside marker blocks. The markers go too; a block that isn't closed goes on to the end; a stray closer stays."""
    marker = F.when(F.col("line").rlike(f"(?i){opens}"), "open").when(F.col("line").rlike(f"(?i){closes}"), "close")
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("_marker", marker).withColumn("_state", F.last("_marker", ignorenulls=True).over(before))
    inside = (F.col("_state") == "open") | (F.col("_marker") == "open")
    return marked.where(~F.coalesce(inside, F.lit(False))).drop("_marker", "_state")


#: The comment lines that fence what stays upstream.
OPENS = r"^\s*#\s*>>>\s*upstream-only\s*>>>"
CLOSES = r"^\s*#\s*<<<\s*upstream-only\s*<<<"


def ignore_additions(upstream: DataFrame, local: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, chunk_id, line_no, line): upstream lines that the local file lacks, with the comments of their chunks.

    Entries are compared trimmed, and case counts. Chunks that add no entry go whole.
    """
    chunks = ignore_chunks(strip_marker_blocks(upstream, OPENS, CLOSES, key), key).withColumn("_entry", trimmed(F.col("line")))
    own = ignore_chunks(local, key).where("kind = 'entry'").select(key, trimmed(F.col("line")).alias("_entry")).distinct()
    missing = chunks.where("kind = 'entry'").join(own, [key, "_entry"], "left_anti").select(key, "chunk_id", "line_no", "line")
    comments = chunks.where("kind = 'comment'").join(missing.select(key, "chunk_id").distinct(), [key, "chunk_id"], "left_semi").select(key, "chunk_id", "line_no", "line")
    return missing.unionByName(comments)


def merge_ignore_lines(upstream: DataFrame, local: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, text): each file's text after a union merge; files that gain nothing are left out.

    Chunks follow in order, a blank line before each (but for the first of a new file); the
    local line ends are kept. A file's lines are put together in one row.
    """
    added = ignore_additions(upstream, local, key)
    item = F.struct("line_no", F.col("line").alias("text"))
    chunk = added.groupBy(key, "chunk_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["text"]).alias("lines"))
    per_file = chunk.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "lines"))).alias("chunks"))
    raw = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["text"])
    old = local.groupBy(key).agg(raw.alias("old"), F.bool_or(F.col("line").endswith("\r")).alias("crlf"))
    both = per_file.join(old, key, "left")
    eol = F.when(F.coalesce("crlf", F.lit(False)), "\r\n").otherwise("\n")
    kept = F.regexp_replace(F.array_join(F.transform("old", lambda x: F.regexp_replace(x, r"\r$", "")), "\n"), r"[\r\n]+$", "")
    body = F.array_join(F.flatten(F.transform("chunks", lambda c: F.concat(F.array(F.lit("")), c["lines"]))), "\n")
    fresh = F.col("old").isNull()
    text = F.when(fresh, F.expr("substring(_body, 2)")).when(F.col("_kept") == "", F.col("_body")).otherwise(F.concat("_kept", F.lit("\n"), "_body"))
    joined = both.withColumn("_body", body).withColumn("_kept", kept)
    return joined.select(key, F.replace(F.concat(text, F.lit("\n")), F.lit("\n"), eol).alias("text"))


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def upsert_managed_block(texts: DataFrame, begin: str, end: str, content: Column) -> DataFrame:
    """texts with new_text and status: Created, Updated, Added, Unchanged or Skipped.

    Skipped: the marks aren't exactly one ordered pair, nor both absent. What is outside the
    block stays as it is; line ends don't count when blocks are compared. All splices are literal.
    """
    t = F.col("text")
    block = F.concat(F.lit(begin + "\n"), F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\n" + end))
    n_begin, n_end = _count(t, begin), _count(t, end)
    at, stop = F.instr(t, begin), F.instr(t, end)
    pair = (n_begin == 1) & (n_end == 1) & (at < stop)
    old = F.substring(t, at, stop - at + len(end))
    spliced = F.concat(F.substring(t, F.lit(1), at - 1), block, F.substring(t, stop + len(end), F.length(t)))
    same = eol_normalize(old) == eol_normalize(block)
    bare = (n_begin == 0) & (n_end == 0)
    status = F.when(t.isNull(), "Created").when(bare, "Added").when(~pair, "Skipped").when(same, "Unchanged").otherwise("Updated")
    added = F.concat(F.regexp_replace(t, r"(?U)\s+\z", ""), F.lit("\n\n"), block, F.lit("\n"))
    new = F.when(status == "Created", F.concat(block, F.lit("\n"))).when(status == "Added", added).when(status == "Updated", spliced).otherwise(t)
    return texts.withColumn("new_text", new).withColumn("status", status)
