"""URL filters: a Bloom filter cascade that is exact over the corpus's own keys.

A rule is a key: a host and the start of a path. A url's candidate keys are the suffixes of
its host with the starts of its path, as long as any rule's. Level 0 encodes the listed
keys; level 1 those candidate keys of the corpus that level 0 takes for listed; level 2 the
listed keys that level 1 takes, and so on until none is left. The first level that denies a
key decides by its number, so membership is exact for every key of the corpus, and a url
needs no join. The cascade's size follows the list, not the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """action (allow or block) for a host with its subdomains where the path starts so; the path begins with a slash."""

    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: str, path: str, lengths: tuple[int, ...], depths: tuple[int, ...]) -> list[str]:
    """Longest first; of equals, the longer host first. depths: how many labels a rule's host can have."""
    labels = host.rsplit(".", max(depths, default=1))
    last = labels if host.count(".") < len(labels) else labels[1:]
    hosts = [".".join(last[-n:]) for n in sorted(depths, reverse=True) if n <= len(last)]
    starts = [path[:n] for n in lengths if n <= len(path)]
    return sorted((h + p for h in hosts if h for p in starts), key=len, reverse=True)


class Bloom:
    """Keys at a false-positive rate; hashed anew at each level."""

    def __init__(self, keys: Iterable[str], rate: float, level: int) -> None:
        keys = list(keys)
        self.level = level
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.bits = max(8, math.ceil(len(keys) * self.hashes / math.log(2)))
        self.words = np.zeros(self.bits, bool)
        for key in keys:
            self.words[self._places(key)] = True
        self.packed, self.words = np.packbits(self.words), np.zeros(0, bool)

    def _places(self, key: str) -> list[int]:
        digest = hashlib.blake2b(key.encode(), digest_size=16, salt=self.level.to_bytes(8, "little")).digest()
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.packed[p >> 3] & (128 >> (p & 7)) for p in self._places(key))


class Cascade:
    """Exact for listed keys and for every key that `others` held."""

    def __init__(self, first: Bloom) -> None:
        self.levels = [first]

    def finish(self, listed: set[str], others: set[str]) -> None:
        """others: all keys of the universe that level 0 takes for listed, without the listed."""
        inside, outside = others, listed
        while inside:
            level = Bloom(inside, 0.5, len(self.levels))
            self.levels.append(level)
            inside, outside = {k for k in outside if k in level}, inside

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    The longest rule that fits decides; where none fits, rule is null and the verdict is the
    cascade's: none of the url's keys is on the block list, so allow. The list of rules is an
    argument and so fits the driver; the false positives it collects are about as many.
    """
    spark = pages.sparkSession
    host, path = host_and_path("_url")
    parsed = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    lengths = tuple(sorted({len(r.path) for r in rules}))
    depths = tuple(sorted({r.host.count(".") + 1 for r in rules}))
    listed = {r.key for r in rules}
    blocked = {r.key for r in rules if r.action == "block"}
    universe = max(1, pages.count() * max(1, len(lengths)) * 4)
    first = Bloom(listed, min(0.5, max(1, len(listed)) / (math.sqrt(2) * universe)), 0)

    def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            keys = {k for h, p in pairs for k in candidate_keys(h, p, lengths, depths)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k in keys if k in first and k not in listed], pa.string())], names=["key"])

    cascade = Cascade(first)
    cascade.finish(listed, {r["key"] for r in parsed.mapInArrow(mistaken, "key string").distinct().collect()})
    # Among the listed keys, a second cascade tells the blocked from the allowed.
    of_blocked = Cascade(Bloom(blocked, 0.5, 0))
    of_blocked.finish(blocked, {k for k in listed - blocked if k in of_blocked.levels[0]})
    shared = spark.sparkContext.broadcast((cascade, of_blocked))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_list, by_block = shared.value
        for batch in batches:
            rule: list[str | None] = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rule.append(next((k for k in candidate_keys(h, p, lengths, depths) if k in by_list), None))
            verdict = ["block" if k is not None and k in by_block else "allow" for k in rule]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["_id", "host", "path", "rule", "verdict"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return parsed.mapInArrow(judge, f"_id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("_id", id_col)
