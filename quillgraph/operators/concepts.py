"""Concepts over languages: how local pages are mapped to ids that all languages share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

SPAN = 1 << 32


def _node(lang, page):
    return lang.cast("long") * SPAN + page.cast("long")


def monolingual(pages: DataFrame) -> DataFrame:
    """(lang_id, page_id, name_space, univ_id): each page a concept of its own; the id packs language and page, so no global order is needed."""
    return pages.select("lang_id", "page_id", "name_space", _node(F.col("lang_id"), F.col("page_id")).alias("univ_id"))


def from_sitelinks(links: DataFrame, languages: DataFrame, pages: DataFrame) -> DataFrame:
    """(lang_id, page_id, name_space, univ_id) from (entity_id, lang, title); titles without a page go."""
    named = links.join(F.broadcast(languages.select("lang", "lang_id")), "lang")  # a row for each language
    got = named.join(pages.select("lang_id", "title", "page_id", "name_space"), ["lang_id", "title"])
    return got.select("lang_id", "page_id", "name_space", F.col("entity_id").alias("univ_id")).distinct()


def aligned(ills: DataFrame, pages: DataFrame, max_votes: int = 2, min_ratio: float = 0.5, lang_count: int | None = None) -> DataFrame:
    """(lang_id, page_id, univ_id): concepts as components of inter-language links.

    A component with one page in each of its languages is a concept. Others keep the links that enough votes support
    and fall into their components; the least node of a component is its id.
    """
    e = graph.cut(ills.select(_node(F.col("source_lang"), F.col("source_id")).alias("src"), F.col("source_lang").alias("src_lang"), _node(F.col("dest_lang"), F.col("dest_id")).alias("dst"), F.col("dest_lang").alias("dst_lang")).distinct())
    every = pages.select(_node(F.col("lang_id"), F.col("page_id")).alias("node"))
    first = graph.cut(graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), every))
    lang = F.floor(F.col("node") / F.lit(SPAN))
    clear = first.groupBy("component").agg((F.countDistinct(lang) == F.count("*")).alias("clear"))
    tagged = graph.cut(first.join(clear, "component"))
    unclear = tagged.where("not clear").select("node")
    rest = e.join(unclear.select(F.col("node").alias("src")), "src", "left_semi")
    kept = graph.split_component(rest, max_votes, min_ratio, lang_count)
    second = graph.components(kept.select(F.col("src").alias("a"), F.col("dst").alias("b")), unclear)
    both = tagged.where("clear").select("node", "component").unionByName(second.select("node", "component"))
    return both.select(F.floor(F.col("node") / F.lit(SPAN)).cast("int").alias("lang_id"), (F.col("node") % F.lit(SPAN)).cast("int").alias("page_id"), F.col("component").alias("univ_id"))


def translate(pages: DataFrame, concepts: DataFrame, to_lang: int) -> DataFrame:
    """(lang_id, page_id, univ_id, to_page_id): the page of the same concept in another language."""
    there = concepts.where(F.col("lang_id") == to_lang).groupBy("univ_id").agg(F.min("page_id").alias("to_page_id"))
    return pages.join(concepts.select("lang_id", "page_id", "univ_id"), ["lang_id", "page_id"]).join(there, "univ_id")


def linked_abroad(pages: DataFrame, concepts: DataFrame, links: DataFrame, to_lang: int) -> DataFrame:
    """(page_id, dest_id): what the page of the same concept in another language links to."""
    t = translate(pages, concepts, to_lang).select("page_id", F.col("to_page_id").alias("source_id"))
    return t.join(links.where(F.col("lang_id") == to_lang).select("source_id", "dest_id"), "source_id").select("page_id", "dest_id").distinct()
