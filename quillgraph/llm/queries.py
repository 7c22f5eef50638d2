"""The operators of this package as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, line_dedup, mixing, quality_clf, quality_rules, sharding, simhash, sp_codec, token_counts, topk
from ._common import tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", F.col("shard_bytes").alias("n_bytes"), F.col("shard_depth").cast("long").alias("depth"), F.col("shard_prefix").alias("prefix"), F.col("shard_page").alias("page"))


#: A limit at which also small tables split several times.
SMALL = 64 << 10


def sharding_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with shards so small that buckets split also where op1's limit holds whole tables."""
    got = sharding.shard(_table(spark, sf_dir, "documents"), SMALL, keep=["doc_id"])
    return got.select("doc_id", F.col("shard_bytes").alias("n_bytes"), F.col("shard_depth").cast("long").alias("depth"), F.col("shard_prefix").alias("prefix"), F.col("shard_page").alias("page"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("distance")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_clf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_quality_rules, op4_line_dedup, op5_html_extraction, op6_sentencepiece, op7_simhash, op8_topk, op9_mixing, op10_quality_classifier, pipeline, sharding_small_shards)}


def _shards(max_bytes: int) -> str:
    """Every row's bucket by definition: the least depth at which its prefix holds no more than the limit."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, l.depth, h >> (60 - l.depth) AS prefix FROM d CROSS JOIN (SELECT unnest(range(0, 61)) AS depth) l),
s AS (SELECT depth, prefix, sum(n_bytes) AS b FROM p GROUP BY ALL HAVING sum(n_bytes) <= {max_bytes}),
m AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM p JOIN s USING (depth, prefix) GROUP BY ALL)
SELECT doc_id, n_bytes, depth::BIGINT AS depth, (h >> (60 - depth))::BIGINT AS prefix, 0::BIGINT AS page FROM m"""


ORACLES = {
    "op1_sharding": _shards(sharding.MAX_BYTES),
    "sharding_small_shards": _shards(SMALL),
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, text, i - 1 AS i, trim(string_split(text, chr(10))[i], ' ') AS t, string_split(text, chr(10))[i] AS raw
           FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, i AS s, lead(i, 2) OVER o AS e, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS w
      FROM l WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM w WHERE e IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM f WHERE r > 1),
k AS (SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_removed,
       (CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END)::BIGINT AS n_chars, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN k USING (doc_id)""",
    "op8_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
