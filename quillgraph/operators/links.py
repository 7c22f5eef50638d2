"""Links, redirects and concepts as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges(links: DataFrame) -> DataFrame:
    """Distinct (source_id, dest_id) with a known target."""
    return links.where("dest_id <> -1").select("source_id", "dest_id").distinct()


def neighbours(links: DataFrame, page_id: int, out: bool = True) -> DataFrame:
    here, there = ("source_id", "dest_id") if out else ("dest_id", "source_id")
    return links.where(F.col(here) == page_id).select(F.col(there).alias("page_id")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(page_id, out_degree, in_degree) over distinct edges, in one pass: each edge counts once for either end."""
    ends = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dest_id").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.page_id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def link_count(links: DataFrame) -> DataFrame:
    """Distinct pairs; the language isn't part of what is told apart."""
    return links.agg(F.countDistinct("source_id", "dest_id").alias("n_links"))


def resolve(links: DataFrame, redirects: DataFrame, column: str = "dest_id") -> DataFrame:
    """``column`` replaced by its redirect target where there is one."""
    r = redirects.select(F.col("src_page_id").alias("__s"), F.col("dest_page_id").alias("__d"))
    return links.join(r, F.col(column) == F.col("__s"), "left").withColumn(column, F.coalesce("__d", column)).drop("__s", "__d")


def resolve_chains(redirects: DataFrame, hops: int = 4) -> DataFrame:
    """(src_page_id, dest_page_id): the first target that is no redirect, over at most ``hops`` hops; else -1."""
    step = redirects.select(F.col("src_page_id").alias("__s"), F.col("dest_page_id").alias("__d"))
    at = redirects.select("src_page_id", F.col("dest_page_id").alias("at"), F.lit(False).alias("over"))
    for _ in range(hops - 1):
        at = at.join(step, F.col("at") == F.col("__s"), "left").select("src_page_id", F.coalesce("__d", "at").alias("at"))
    last = at.join(step.select(F.col("__s").alias("again")), F.col("at") == F.col("again"), "left")
    return last.select("src_page_id", F.when(F.col("again").isNull() & F.col("at").isNotNull(), F.col("at")).otherwise(-1).alias("dest_page_id"))


def redirects_to(redirects: DataFrame, gather: bool = True) -> DataFrame:
    """(dest_page_id, sources): the inverse; a row (dest_page_id, source) for each redirect if they aren't to be gathered, as of pages that very many lead to."""
    if not gather:
        return redirects.select("dest_page_id", F.col("src_page_id").alias("source")).distinct()
    return redirects.groupBy("dest_page_id").agg(F.sort_array(F.collect_set("src_page_id")).alias("sources"))


def follow_pages(pages: DataFrame, redirects: DataFrame, valid=None) -> DataFrame:
    """Redirect pages replaced by their target where the target passes ``valid``; others stay as they are."""
    valid = F.lit(True) if valid is None else valid
    target = pages.where(valid).select(*[F.col(c).alias(f"t_{c}") for c in pages.columns])
    r = redirects.select(F.col("src_page_id").alias("__s"), F.col("dest_page_id").alias("__d"))
    j = pages.join(r, pages["page_id"] == F.col("__s"), "left").join(target, F.col("__d") == F.col("t_page_id"), "left")
    use = F.col("is_redirect") & F.col("t_page_id").isNotNull()
    return j.select(F.col("page_id").alias("asked_id"), *[F.when(use, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in pages.columns])


def link_targets(parsed: DataFrame, pages: DataFrame, on: str = "title") -> DataFrame:
    """Links by title get their page's id, -1 for a red link."""
    p = pages.select(F.col(on).alias("__t"), F.col("page_id").alias("dest_id"))
    return parsed.join(p, F.col("dest_title") == F.col("__t"), "left").drop("__t").withColumn("dest_id", F.coalesce("dest_id", F.lit(-1)))


def missing_links(new: DataFrame, known: DataFrame) -> DataFrame:
    """Links of one store that another hasn't: an exact anti-join."""
    return new.join(known.select("source_id", "dest_id"), ["source_id", "dest_id"], "left_anti")


def universal_links(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Local links with the concepts of both ends, -1 where a page has none."""
    s = concepts.select("lang_id", F.col("page_id").alias("source_id"), F.col("univ_id").alias("univ_source_id"))
    d = concepts.select("lang_id", F.col("page_id").alias("dest_id"), F.col("univ_id").alias("univ_dest_id"))
    j = links.join(s, ["lang_id", "source_id"], "left").join(d, ["lang_id", "dest_id"], "left")
    return j.withColumn("univ_source_id", F.coalesce("univ_source_id", F.lit(-1))).withColumn("univ_dest_id", F.coalesce("univ_dest_id", F.lit(-1)))


def skeletal_links(universal: DataFrame) -> DataFrame:
    """(univ_source_id, univ_dest_id, langs): languages that have the link, merged."""
    return universal.where("univ_source_id <> -1 and univ_dest_id <> -1").groupBy("univ_source_id", "univ_dest_id").agg(F.sort_array(F.collect_set("lang_id")).alias("langs"))


def universal_neighbours(skeletal: DataFrame, out: bool = True, gather: bool = True) -> DataFrame:
    """(univ_id, others, langs): what each concept links to, or what links to it; a row (univ_id, other, langs) for each link if they aren't to be gathered, as of hubs."""
    here, there = ("univ_source_id", "univ_dest_id") if out else ("univ_dest_id", "univ_source_id")
    if not gather:
        return skeletal.select(F.col(here).alias("univ_id"), F.col(there).alias("other"), "langs")
    return skeletal.groupBy(F.col(here).alias("univ_id")).agg(F.sort_array(F.collect_set(there)).alias("others"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("langs")))).alias("langs"))


def concept_pages(concepts: DataFrame) -> DataFrame:
    """(univ_id, pages): each concept's pages in every language."""
    return concepts.groupBy("univ_id").agg(F.sort_array(F.collect_set(F.struct("lang_id", "page_id"))).alias("pages"))


def local_page_of(concepts: DataFrame, lang_id: int) -> DataFrame:
    """(univ_id, page_id) in a language: the page with the least id."""
    return concepts.where(F.col("lang_id") == lang_id).groupBy("univ_id").agg(F.min("page_id").alias("page_id"))


def concept_of(pages: DataFrame, concepts: DataFrame) -> DataFrame:
    return pages.join(concepts.select("lang_id", "page_id", "univ_id"), ["lang_id", "page_id"], "left").withColumn("univ_id", F.coalesce("univ_id", F.lit(-1)))


def valid_inter_language(ills: DataFrame, pages: DataFrame, langs: list[int] | None = None) -> DataFrame:
    """Inter-language links with both ends known and an allowed target language."""
    p = pages.select("lang_id", "page_id")
    a = p.toDF("source_lang", "source_id")
    b = p.toDF("dest_lang", "dest_id")
    out = ills.join(a, ["source_lang", "source_id"], "left_semi").join(b, ["dest_lang", "dest_id"], "left_semi")
    return out.where(F.col("dest_lang").isin(langs)) if langs else out


def with_sibling_links(ills: DataFrame, concepts: DataFrame) -> DataFrame:
    """Inter-language links and those between pages of one concept."""
    a = concepts.select("univ_id", F.col("lang_id").alias("source_lang"), F.col("page_id").alias("source_id"))
    b = concepts.select("univ_id", F.col("lang_id").alias("dest_lang"), F.col("page_id").alias("dest_id"))
    cols = ["source_lang", "source_id", "dest_lang", "dest_id"]
    siblings = a.join(b, "univ_id").where("source_lang <> dest_lang").select(*cols)
    return ills.select(*cols).unionByName(siblings).distinct()


def hop_distance(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, hops): 1 if linked either way, else 2."""
    both = e.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).unionByName(e.select(F.col("dest_id").alias("a"), F.col("source_id").alias("b"))).distinct().withColumn("__has", F.lit(1))
    return pairs.join(both, ["a", "b"], "left").withColumn("hops", F.when(F.col("__has") == 1, 1).otherwise(2)).drop("__has")


def compare_stores(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, added, removed): differences of out-links between two stores."""
    j = old.select("source_id", "dest_id", F.lit(1).alias("o")).join(new.select("source_id", "dest_id", F.lit(1).alias("n")), ["source_id", "dest_id"], "full_outer")
    return j.groupBy(F.col("source_id").alias("page_id")).agg(F.count(F.when(F.col("o").isNull(), 1)).alias("added"), F.count(F.when(F.col("n").isNull(), 1)).alias("removed"))


def title_index(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(lang_id, name_space, title, page_id): titles to pages with redirects resolved; the least id for a repeated title."""
    return resolve(pages, redirects, "page_id").groupBy("lang_id", "name_space", "title").agg(F.min("page_id").alias("page_id"))


def multi_get(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """A row for each key, with nulls for those missing."""
    return keys.join(table, on, "left")


def top(df: DataFrame, k: int, by: list, keys: list[str], rank: str = "rank") -> DataFrame:
    """The k first rows of each key; ``by`` must end in an id so that ties are settled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(rank) <= k)


def single_edges(asked: DataFrame, links: DataFrame) -> DataFrame:
    """The first link, by place in the text, of each asked (lang_id, source_id, dest_id); nulls where there is none."""
    keys = ["lang_id", "source_id", "dest_id"]
    rest = [c for c in links.columns if c not in keys]
    first = links.groupBy(*keys).agg(F.min(F.struct("location", *[c for c in rest if c != "location"])).alias("e"))
    return asked.select(*keys).distinct().join(first, keys, "left").select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def languages_of(ills: DataFrame, pages: DataFrame, outward: bool = True) -> DataFrame:
    """(lang_id, page_id, others): for each asked page (lang_id, page_id) the sorted pages that it links to in other languages, or that link to it."""
    here, there = ("source", "dest") if outward else ("dest", "source")
    e = ills.select(F.col(f"{here}_lang").alias("lang_id"), F.col(f"{here}_id").alias("page_id"), F.struct(F.col(f"{there}_lang").alias("lang_id"), F.col(f"{there}_id").alias("page_id")).alias("o"))
    found = e.groupBy("lang_id", "page_id").agg(F.sort_array(F.collect_set("o")).alias("others"))  # a page has a link or two for each language
    return pages.select("lang_id", "page_id").distinct().join(found, ["lang_id", "page_id"], "left").withColumn("others", F.coalesce("others", F.array().cast(found.schema["others"].dataType)))


def category_targets(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Category links (lang_id, article_id, category) with the id of the category's page, -1 where none has that title."""
    c = pages.where("name_space = 14").select("lang_id", F.col("title").alias("category"), F.col("page_id").alias("category_id"))
    return parsed.join(c, ["lang_id", "category"], "left").withColumn("category_id", F.coalesce("category_id", F.lit(-1)))
