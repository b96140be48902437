"""What a run leaves behind, and how often it goes over the texts."""

from __future__ import annotations

import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convoy.llm import lm
from convoy.llm.byte_tokens import column_encoder
from convoy.llm.queries import tokenizer_path
from convoy.llm.shared import shared_dir

HELD = """
import re
from convoy.llm.shared import lean

def own():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

kept = []

def run(batches):
    # What stays lies behind what goes, so that C's allocator can't shorten its heap by itself.
    gone = [bytes(1_000) for _ in range(100_000)]
    kept.append(bytes(1_000))
    yield from batches

before = own()
assert list(lean(run)(iter([1, 2]))) == [1, 2]
print(own() - before)
"""


def test_a_worker_gives_back_what_its_task_used():
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(said.stdout) < 30  # of some 100 MB


def test_lm_keeps_no_counts_and_tells_sizes_with_the_words(spark):
    rows = [(i, f"the cat sat on the mat {i % 3}") for i in range(40)] + [(7, "the cat sat on the mat 1"), (50, None), (51, "")]
    start = time.time()
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 3)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    folder = Path(shared_dir(spark).removeprefix("file://"))
    assert not [p for p in folder.rglob("lm_counted_*") if p.stat().st_mtime >= start]
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((i, len((t or "").split()) + 1) for i, t in rows)


def test_lm_weights_are_joined_once_and_asked_in_one_pass_each(spark, monkeypatch):
    """Pairs' and triples' sums took two passes over the texts each, and their weights were joined again for each; what leads to the weights goes."""
    asked, root = [], Path(shared_dir(spark).removeprefix("file://")) / "convoy"
    plain = lm.sum_weights

    def seen(rows, weights, n, parts, *rest):
        asked.append((n, "Join" in weights._jdf.queryExecution().optimizedPlan().toString()))
        return plain(rows, weights, n, parts, *rest)

    monkeypatch.setattr(lm, "sum_weights", seen)
    before = set(root.glob("**/lm_*"))
    rows = [(i, f"a b c d e w{i % 3}") for i in range(40)]
    assert lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 1).count() == 40
    assert asked == [(1, False), (2, False), (3, False)]
    left = {p.name for p in set(root.glob("**/lm_*")) - before}
    assert not left & {"lm_pairs", "lm_triples", "lm_pair_backoffs"} and {f"lm_weights_{n}" for n in (1, 2, 3)} <= left


def test_keys_ascend_also_where_their_upper_bits_are_alike():
    r = np.random.default_rng(3)
    for key in (r.integers(0, 1 << 64, 5_000, np.uint64), r.integers(0, 1 << 10, 5_000, np.uint64), np.arange(9, dtype=np.uint64)[::-1], np.zeros(0, np.uint64)):
        by, ascending = lm._ascending(key)
        assert ascending.tolist() == sorted(key.tolist()) == key[by].tolist() and sorted(by.tolist()) == list(range(len(key)))


def test_a_column_is_encoded_as_its_texts_and_units_once():
    """Each word of each text was looked up by itself; now a slice's distinct ones are."""
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    r = random.Random(1)
    some = [" ", "\n", "\t", " ", " ", "\x0b", "\x1c", "a", "bc ", "foo ", "'s", "é", "Ω ", "日", "1", "<|x", "..", " bar"]
    texts = [None, "", " ", "\n", "  ", "\n\n", " \n", "a\n", "a ", "\na", " a"] + ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(4_000)]
    ids, bounds = column_encoder(tokenizer_path("byte_bpe_50k.json"))(pa.array(["x", *texts]).slice(1))
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(ids)
    for text, lo, hi in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[lo:hi].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
    ids, bounds = column_encoder(tokenizer_path("byte_bpe_50k.json"))(pa.array([], pa.string()))
    assert not len(ids) and bounds.tolist() == [0]
