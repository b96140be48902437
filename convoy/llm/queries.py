"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import bpe, centroids, exact_dedup, language_id, lm, mixing, negatives, ngram_join, substring_dedup, suffix_dedup, token_files, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


#: Rows of an Arrow batch: texts are long, and a batch is in memory on both sides.
BATCH_ROWS = 2_000
#: The same for rows that hold blocks of vectors.
BLOCK_ROWS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"), language_id.in_fold("doc_id", 5, 1))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Fixed: the rules of the contract.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.page_id, max_by(r.h || r.s, length(r.h || r.s)) AS rule, max_by(r.action, length(r.h || r.s)) AS action
 FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.in_fold("doc_id", 4, 2)
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 50)


OP7_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(files)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_sort(F.array_distinct("draws.shard")).alias("shards"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS t FROM (SELECT doc_id, x, unnest(range(n - 99)) AS s FROM d) u),
r AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM w) o WHERE k > 1),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM r),
c AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, g),
l AS (SELECT c.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM c),
k AS (SELECT l.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(d.x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS x, max(b) AS b FROM l JOIN d ON d.doc_id = l.doc_id GROUP BY l.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(concat(coalesce(k.x, ''), substr(d.x, 2 * coalesce(k.b, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    # A row of a block is some megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCK_ROWS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label))


OP12_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, x.vec_id, x.label, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v a JOIN v x ON a.vec_id % 50 = 0 AND x.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = own) q WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
 row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 10) -> str:
    away = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = "SELECT vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS b FROM (SELECT v.vec_id, v.v, c.k, {away} AS d FROM v CROSS JOIN c{r} c) t GROUP BY vec_id"
    # A quotient rounds toward zero; taking off the remainder first makes it a floor.
    mean = "SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) u GROUP BY k, i) w GROUP BY k"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT sha256(concat('3:', CAST(vec_id AS STRING))) AS h, v AS c FROM v ORDER BY h LIMIT 8) f)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(away=away, r=r)})")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({mean.format(r=r)}) m ON m.k = o.k)")
    told = f"SELECT a.vec_id, CAST(a.b.k AS INTEGER) AS cluster, a.b.d AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.b.k"
    return f"WITH {', '.join(parts)} {told}"


def queries() -> dict[str, Query]:
    return {
        "op8_exact_dedup": op8_exact_dedup,
        "op1_ngram_join": op1_ngram_join,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_bpe": op3_bpe,
        "op4_url_filter": op4_url_filter,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_top_k": op7_top_k,
        "op9_token_files": op9_token_files,
        "op10_mix_sources": op10_mix_sources,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": OP4_SQL,
        "op11_suffix_dedup": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_centroids": _op13_sql(),
        "op7_top_k": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
    }
