"""The engine's verbs as functions: each takes tables and returns a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, links, phrases, similarity, wikify


class Engine:
    """Pages, links and phrases of one language, and what can be asked of them.

    ``pages`` has (page_id, title), ``edges`` distinct (source_id, dest_id), ``anchors`` (anchor, page_id).
    """

    def __init__(self, spark: SparkSession, pages: DataFrame, edges: DataFrame, anchors: DataFrame | None = None, members: DataFrame | None = None):
        self.spark, self.pages, self.edges, self.anchors, self.members = spark, pages, edges, anchors, members

    def languages(self, pages_by_lang: DataFrame) -> DataFrame:
        return pages_by_lang.groupBy("lang_id").agg(F.count("*").alias("pages"))

    def entities(self, asked: DataFrame) -> DataFrame:
        """(key, page_id) from (key, kind, value): kinds are articleId, title and phrase; null where nothing is meant."""
        by_id = asked.where("kind = 'articleId'").select("key", F.col("value").try_cast("long").alias("page_id"))
        by_title = asked.where("kind = 'title'").join(self.pages.select(F.col("title").alias("value"), "page_id"), "value", "left").select("key", "page_id")
        out = by_id.unionByName(by_title)
        if self.anchors is not None:
            best = phrases.top_sense(phrases.resolve(phrases.counts(self.anchors), 1)).select(F.col("phrase").alias("value"), "page_id")
            from .functions.text import normalise

            out = out.unionByName(asked.where("kind = 'phrase'").withColumn("value", normalise(F.col("value"))).join(best, "value", "left").select("key", "page_id"))
        return out

    def _scores(self, metric: str, pairs: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Scores of the asked ``pairs`` (a, b), or of the asked ``rows`` (row_id) with all others: no others are computed."""
        n = self.pages.count()
        inlink = lambda: similarity.inlink(self.edges, n, pairs, rows)
        outlink = lambda: similarity.outlink(self.edges, pairs, rows)
        if metric == "inlink":
            return inlink()
        if metric == "outlink":
            return outlink()
        if metric == "milne-witten":
            return similarity.milne_witten(inlink(), outlink())
        if metric == "direct-link":
            return similarity.direct_link(self.edges)
        if metric == "syn-rank":
            return similarity.syn_rank(self.edges, n, self.edges, pairs)
        raise ValueError(metric)

    def similarity(self, pairs: DataFrame, metric: str = "milne-witten") -> DataFrame:
        """(a, b, score) of asked pairs; 1 for a page with itself, 0 for pairs that share nothing."""
        j = pairs.select("a", "b").join(self._scores(metric, pairs), ["a", "b"], "left")
        return j.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))

    def cosimilarity(self, rows: DataFrame, cols: DataFrame, metric: str = "milne-witten") -> DataFrame:
        """(a, b, score) for all pairs of two stated lists (id); only these are scored."""
        asked = rows.select(F.col("id").alias("a")).distinct().crossJoin(cols.select(F.col("id").alias("b")).distinct())  # what is asked for
        return similarity.cosimilarity(self._scores(metric, asked), rows, cols)

    def most_similar(self, ids: DataFrame, k: int = 10, metric: str = "inlink", valid: DataFrame | None = None) -> DataFrame:
        """(a, rank, b, score) for the asked (page_id)."""
        rows = ids.select(F.col("page_id").alias("row_id")).distinct()
        return similarity.most_similar(self._scores(metric, rows=rows).join(rows.withColumnRenamed("row_id", "a"), "a", "left_semi"), k, valid)

    def vector(self, ids: DataFrame, out: bool = False) -> DataFrame:
        """(row_id, col_id, value): link vectors of the asked pages."""
        return similarity.link_vectors(self.edges, out=out).join(ids.select(F.col("page_id").alias("row_id")).distinct(), "row_id", "left_semi")

    def page_rank(self, ids: DataFrame | None = None) -> DataFrame:
        r = graph.pagerank(self.edges)
        return r if ids is None else ids.select("page_id").join(r, "page_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))

    def articles_in_category(self, category_id: int) -> DataFrame:
        return self.members.where(F.col("category_id") == category_id).select(F.col("article_id").alias("page_id")).join(self.pages, "page_id")

    def categories_for_article(self, page_id: int) -> DataFrame:
        return self.members.where(F.col("article_id") == page_id).select("category_id").distinct()

    def wikify(self, docs: DataFrame, known: DataFrame, senses: DataFrame, metric: str = "inlink", **how) -> DataFrame:
        degree = links.degrees(self.edges).select("page_id", F.col("in_degree"))
        return wikify.milne_witten(docs, known, senses, self._scores(metric), degree, **how)
