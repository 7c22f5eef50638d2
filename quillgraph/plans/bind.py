"""The engine's tables, made from the tables at hand, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LANGS = {"en": 1, "de": 2, "fr": 3, "es": 4}


def r(column: str, places: int = 6):
    return F.round(column, places).alias(column)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders link to parts; one edge for each pair."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("dest_id")).distinct()


EDGES = "e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS source_id, l_partkey AS dest_id FROM lineitem)"


def links(spark: SparkSession, d: str) -> DataFrame:
    """Every order line as a link with anchor, place and flags; lines of small quantity are red links."""
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("location"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("anchor_text"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("lang_id"),
        F.col("l_orderkey").alias("source_id"), F.when(F.col("l_quantity") < 3, F.lit(-1)).otherwise(F.col("l_partkey")).cast("long").alias("dest_id"),
        (F.col("l_discount") < 0.05).alias("is_parseable"), (F.col("l_linenumber") % 3).cast("int").alias("location_type"),
    )


LINKS = """links AS MATERIALIZED (SELECT l_linenumber::INTEGER AS location, l_returnflag || ' ' || l_linestatus AS anchor_text, (l_suppkey % 4 + 1)::INTEGER AS lang_id, l_orderkey AS source_id,
  (CASE WHEN l_quantity < 3 THEN -1 ELSE l_partkey END)::BIGINT AS dest_id, l_discount < 0.05 AS is_parseable, (l_linenumber % 3)::INTEGER AS location_type FROM lineitem)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages of four languages, some of them categories, redirects or disambiguation pages."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        (p % 4 + 1).cast("int").alias("lang_id"), p.alias("page_id"), F.concat("p_brand", F.lit(" "), p.cast("string")).alias("title"), F.when(p % 10 == 0, 14).otherwise(0).alias("name_space"),
        (p % 7 == 0).alias("is_redirect"), (p % 11 == 0).alias("is_disambig"), "p_size", "p_type",
    )


PAGES = """pages AS MATERIALIZED (SELECT (p_partkey % 4 + 1)::INTEGER AS lang_id, p_partkey AS page_id, p_brand || ' ' || p_partkey::VARCHAR AS title, (CASE WHEN p_partkey % 10 = 0 THEN 14 ELSE 0 END)::INTEGER AS name_space,
  p_partkey % 7 = 0 AS is_redirect, p_partkey % 11 = 0 AS is_disambig, p_size, p_type FROM part)"""


def redirects(spark: SparkSession, d: str) -> DataFrame:
    """Chains of redirects: each seventh part to its half, rounded down to another seventh or not."""
    p = F.col("p_partkey")
    return table(spark, d, "part").where(p % 7 == 0).select(p.alias("src_page_id"), F.when(p % 2 == 0, F.floor(p / 2)).otherwise(p + 1).cast("long").alias("dest_page_id"))


REDIRECTS = "redirects AS MATERIALIZED (SELECT p_partkey AS src_page_id, (CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE p_partkey + 1 END)::BIGINT AS dest_page_id FROM part WHERE p_partkey % 7 = 0)"


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of four languages share a concept; each thirteenth page has none."""
    p = F.col("p_partkey")
    return table(spark, d, "part").where(p % 13 != 0).select((p % 4 + 1).cast("int").alias("lang_id"), p.alias("page_id"), F.floor(p / 4).cast("long").alias("univ_id"))


CONCEPTS = "concepts AS MATERIALIZED (SELECT (p_partkey % 4 + 1)::INTEGER AS lang_id, p_partkey AS page_id, p_partkey // 4 AS univ_id FROM part WHERE p_partkey % 13 <> 0)"


def views(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import pageviews

    return pageviews.hourly(table(spark, d, "events"), F.col("user_id"), F.col("ts"), (F.col("user_id") % 2 + 1).cast("int"))


VIEWS = "views AS MATERIALIZED (SELECT (user_id % 2 + 1)::INTEGER AS lang_id, user_id AS page_id, date_trunc('hour', ts) AS tstamp, count(*) AS num_views FROM events GROUP BY ALL)"


def members(spark: SparkSession, d: str) -> DataFrame:
    """(category_id, article_id): parts are in the category of their size."""
    return table(spark, d, "part").select(F.col("p_size").cast("long").alias("category_id"), F.col("p_partkey").alias("article_id"))


def category_tree(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): a category of size c lies in those of c / 2 and c / 3."""
    c = table(spark, d, "part").select(F.col("p_size").cast("long").alias("child")).where("child > 1").distinct()
    return c.select("child", F.explode(F.array_distinct(F.array(F.greatest(F.lit(1), F.floor(F.col("child") / 2)).cast("long"), F.greatest(F.lit(1), F.floor(F.col("child") / 3)).cast("long")))).alias("parent"))


TREE = """tree AS MATERIALIZED (SELECT DISTINCT child, greatest(1, child // k)::BIGINT AS parent FROM (SELECT DISTINCT p_size::BIGINT AS child FROM part WHERE p_size > 1) CROSS JOIN (VALUES (2), (3)) v(k))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


TOKEN = r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]+"
TOKENS = f"toks AS MATERIALIZED (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS t FROM documents)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, lon, lat): customers at places that follow from their keys."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 53 % 1700) / 10.0 - 85).alias("lat"))


POINTS = "points AS MATERIALIZED (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)"
METRES = "(2 * 6372800.0::DOUBLE * asin(sqrt(least(1.0, sin(radians({b}.lat - {a}.lat) / 2) ^ 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2) ^ 2))))"
