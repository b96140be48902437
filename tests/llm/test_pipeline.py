"""Each stage against a brute-force version, on its own input."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import pytest
from test_llm import jaccard

from convoy.llm.queries import tokenizer_path
from convoy.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, SF), name.replace(" ", "_"))
        found.append(docs)
    return [df.collect() for df in found]


def test_shape(stages):
    assert [n for n, _ in C.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == list(stages[0][0].asDict())


def test_languages_keep_all_prose(stages):
    assert {r.doc_id for r in stages[1]} == {r.doc_id for r in stages[0] if re.search(r"[^\W\d_]", r.text or "")}


def test_exact_copies_go(stages):
    best: dict[str, int] = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        best[key] = min(best.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(best.values())


def test_near_copies_go(stages):
    placed = jaccard([(r.doc_id, r.text) for r in stages[2]], 5, 80, 100)
    assert {r.doc_id for r in stages[3]} == {i for i, (_, c) in placed.items() if i == c}


def test_mix_repeats_whole_documents(stages):
    before = {r.doc_id: r for r in stages[3]}
    times = Counter(r.doc_id for r in stages[4])
    assert max(times.values()) <= 2 and all(before[r.doc_id] == r for r in stages[4])
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert size(stages[4]) == pytest.approx(1.5 * size(stages[3]), rel=0.15)


CLASHING = "doc_id long, text string, lang string, source string, component_id long, keep_id string, size long, _id string, _h string, draws string, lang_pred string, token_ids string, file int"


def through(spark, rows):
    """The rows before the first stage and after each, and the columns after each."""
    df = spark.createDataFrame(rows, CLASHING)
    found, columns = [df.collect()], [df.columns]
    for name, stage in C.STAGES:
        df = C.materialize(stage(spark, df, "nowhere"), name.replace(" ", "_"))
        found.append(df.collect())
        columns.append(df.columns)
    return found, columns


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    other = (5, "k", 7, None, "h", "d", "l", "t", 1)
    rows = [
        (1, "The same text, twice over, and then some more of it.", "en", "a", *other),
        (2, "The same  text, twice over,\nand then some more of it.", "en", "a", *other),
        (2, "The same  text, twice over,\nand then some more of it.", "en", "a", *other),
        (3, None, None, None, *[None] * 9),
        (4, "", "en", "b", *other),
        (5, " \t\n", "fr", "b", *other),
        (6, long, "en", None, *[None] * 9),
        (7, long + " end", "en", "c", *other),
        (8, "un", "fr", "c", *other),
        (9, "!!! 123 ...", None, "c", *other),
        (10, "straße é 日本 \x1c x", "fr", "é", *other),
        (None, "pas de nombre ici", "fr", "a", *other),
    ]
    found, columns = through(spark, rows)
    assert all(c == columns[0] for c in columns[:-1])
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
    # Two languages: one has half of the score at least, so only texts without a letter go.
    assert Counter(found[1]) == Counter(r for r in found[0] if re.search(r"[^\W\d_]", r.text or ""))
    assert Counter(map(norm, found[2])) == Counter(set(map(norm, found[1])))
    assert {r.doc_id for r in found[2]} == {1, 6, 7, 8, 10, None}
    # 7 is 6 and one word more; a row without an id stays.
    assert {r.doc_id for r in found[3]} == {1, 6, 8, 10, None} and len(found[3]) == 5
    assert set(found[4]) <= set(found[3]) and max(Counter(found[4]).values()) <= 2
    assert Counter(r.doc_id for r in found[5]) == Counter(r.doc_id for r in found[4])


def test_no_labels_and_no_rows(spark):
    found, columns = through(spark, [(1, "some words", None, None, *[None] * 9), (2, None, None, None, *[None] * 9)])
    assert len(found[1]) == 2 and {r.doc_id for r in found[3]} == {1, 2}
    found, columns = through(spark, [])
    assert found == [[]] * 6 and columns[-1] == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"]


def test_encoding(stages):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        assert np.array_equal(r.token_ids, theirs.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.n_tokens == len(r.token_ids)


def test_near_copies_leave_only_their_ids(spark):
    """What the join writes on the way would stand beside the next stage's shuffles."""
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i % 2}") for i in range(6)], "doc_id long, text string")
    written = lambda: {p.parent for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet")}
    before = written()
    assert [r.doc_id for r in C.drop_near_copies(spark, docs, "nowhere").orderBy("doc_id").collect()] == [0, 1]
    assert {p.name for p in written() - before} == {"near_copies"}
