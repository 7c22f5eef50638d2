"""Texts and phrases as vectors of concepts, and cosines of dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phrases
from .links import top


def text_vectors(docs: DataFrame, index: DataFrame, n_docs: int, max_terms: int = 20, min_tf: int = 2, min_df: int = 5, max_share: float = 0.05, k: int = 1000) -> DataFrame:
    """(row_id, col_id, value): for each text the concepts (documents of ``index``) that its best terms hit, of length 1.

    A text's terms are those of sufficient count and neither rare nor common, the ``max_terms`` best by tf * idf.
    ``index`` has (doc_id, term, tf).
    """
    df = index.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    idf = F.log(F.lit(float(n_docs)) / (F.col("df") + 1)) + 1
    q = phrases.term_index(docs).where(F.col("tf") >= min_tf).join(df, "term").withColumn("w", F.col("tf") * idf)
    q = top(q, max_terms, [F.desc("w"), F.asc("term")], ["doc_id"]).select(F.col("doc_id").alias("query_id"), "term", F.col("w"))
    size = index.groupBy("doc_id").agg(F.sum("tf").alias("size"))
    hit = q.join(index, "term").join(df, "term").join(size, "doc_id")
    s = hit.groupBy(F.col("query_id").alias("row_id"), F.col("doc_id").alias("col_id")).agg(F.sum(F.sqrt(F.col("tf").cast("double")) * idf * F.col("w") / F.sqrt(F.col("size").cast("double"))).alias("score"))
    return prune(s, k)


def prune(s: DataFrame, k: int = 1000, gap: int = 100, least: float = 0.005) -> DataFrame:
    """(row_id, col_id, value): the k best, cut where ``gap`` ranks gain less than ``least`` of the best; of length 1."""
    from pyspark.sql.window import Window

    w, whole = Window.partitionBy("row_id").orderBy(F.desc("score"), "col_id"), Window.partitionBy("row_id")
    r = top(s, k, [F.desc("score"), F.asc("col_id")], ["row_id"]).withColumn("ahead", F.lead("score", gap).over(w)).withColumn("best", F.max("score").over(whole))
    flat = F.col("ahead").isNotNull() & (F.col("score") - F.col("ahead") < least * F.col("best"))
    r = r.withColumn("end", F.min(F.when(flat, F.col("rank"))).over(whole)).where("end is null or rank <= end")
    return r.select("row_id", "col_id", (F.col("score") / F.sqrt(F.sum(F.col("score") * F.col("score")).over(whole))).alias("value"))


def concept_vectors(neighbours: DataFrame) -> DataFrame:
    """(row_id, col_id, value): lists of nearest concepts (a, rank, b, score) as vectors."""
    return neighbours.where("score > 0").select(F.col("a").alias("row_id"), F.col("b").alias("col_id"), F.col("score").alias("value"))


def best_of(*vectors: DataFrame) -> DataFrame:
    """(row_id, col_id, value): each row's vector from the first table that has one."""
    out = vectors[0]
    for v in vectors[1:]:
        out = out.unionByName(v.join(out.select("row_id").distinct(), "row_id", "left_anti"))
    return out


def known_phrases(store: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """(phrase_id, phrase, col_id, value): vectors of phrases added to a store; a phrase that is there stays as it is."""
    new = fresh.select(F.xxhash64(F.lower(F.trim("phrase"))).alias("phrase_id"), "phrase", "col_id", "value")
    return new if store is None else store.unionByName(new.join(store.select("phrase_id").distinct(), "phrase_id", "left_anti"))


MODES = ("none", "generator", "creator", "both")


def phrase_vectors_by(mode: str, phrases_: DataFrame, generated: DataFrame, created: DataFrame, senses: DataFrame, pages: DataFrame) -> DataFrame:
    """(phrase, col_id, value): the vectors of phrases by mode: what a generator has for them, what is created from candidates, or both in turn.

    Where that gives none, and always in mode "none", a phrase has the vector of the page that it most likely means: ``senses``
    is (phrase, page_id, rank), ``pages`` vectors (row_id, col_id, value).
    """
    if mode not in MODES:
        raise ValueError(mode)
    best = senses.where("rank = 1").select(F.col("page_id").alias("row_id"), "phrase").join(pages, "row_id").select(F.col("phrase").alias("row_id"), "col_id", "value")
    tables = ([generated] if mode in ("generator", "both") else []) + ([created] if mode in ("creator", "both") else []) + [best]
    asked = phrases_.select(F.col("phrase").alias("row_id")).distinct()
    return best_of(*tables).join(asked, "row_id", "left_semi").select(F.col("row_id").alias("phrase"), "col_id", "value")
