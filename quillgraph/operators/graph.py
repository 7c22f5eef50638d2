"""Graph algorithms as rounds of joins; each round's frame is checkpointed so that plans stay short and loss is cheap."""

from __future__ import annotations

import re
import tempfile
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import top


#: Rounds between checkpoints where a round's plan has the one before it once.
_CUT = 4


def shared_folder(spark) -> str:
    """The folder that driver and executors share, from the session (one of our own only where that is unset and one machine does all)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, standard: bool = False) -> DataFrame:
    """(page_id, rank) over distinct (source_id, dest_id).

    Pages start at 1/n, n the pages with out-links. A round pushes rank / out-degree to the targets; pages that get
    some have (1 - d) / m + d * sum, m the number of such pages; pages without in-links keep 1/n and the mass of pages
    without out-links is lost. With ``standard`` dangling mass is spread and every page has the teleport share.
    """
    e = cut(edges.select("source_id", "dest_id").distinct())
    out = e.groupBy("source_id").agg(F.count("*").alias("deg"))
    if standard:
        nodes = cut(e.select(F.col("source_id").alias("page_id")).union(e.select("dest_id")).distinct())
        n = nodes.count()
        e = cut(e.join(out, "source_id"))
        ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
        for _ in range(iterations):
            pushed = e.join(ranks, e.source_id == ranks.page_id).groupBy(F.col("dest_id").alias("page_id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
            lost = ranks.join(out, ranks.page_id == out.source_id, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            ranks = cut(nodes.join(pushed, "page_id", "left").join(F.broadcast(lost)).select("page_id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
        return ranks
    n = out.count()
    m = e.select("dest_id").distinct().count()
    # pages without in-links never change, and only they do not: what a round adds to is the same set each time
    still = cut(out.select(F.col("source_id").alias("page_id")).join(e.select(F.col("dest_id").alias("page_id")).distinct(), "page_id", "left_anti").withColumn("rank", F.lit(1.0 / max(n, 1))))
    e = cut(e.join(out, "source_id")).repartition("source_id").persist(StorageLevel.MEMORY_AND_DISK)  # dealt by source once for all rounds
    ranks = out.select(F.col("source_id").alias("page_id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(1, iterations + 1):
        pushed = e.join(ranks, e.source_id == ranks.page_id).groupBy(F.col("dest_id").alias("page_id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ranks = pushed.select("page_id", (F.lit((1 - damping) / max(m, 1)) + damping * F.col("got")).alias("rank")).unionByName(still)
        ranks = cut(ranks) if k % _CUT == 0 or k == iterations else ranks
    e.unpersist()
    return ranks


def category_costs(child_parent: DataFrame, pages: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(cat, pr, cost): PageRank up the category graph and the cost 1 / -ln(pr) of a category.

    ``child_parent`` has (child, parent), ``pages`` (cat, page_id). A category starts with its share of categories and
    pages, and each round passes d * pr / parents to each parent on top of (1 - d) / N.
    """
    e = child_parent.select("child", "parent").distinct()
    held = pages.groupBy("cat").agg(F.countDistinct("page_id").alias("n"))
    cats = e.select(F.col("child").alias("cat")).union(e.select("parent")).union(held.select("cat")).distinct().join(held, "cat", "left").select("cat", F.coalesce("n", F.lit(0)).alias("n"))
    cats = cut(cats)
    count, total = cats.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranks = cats.select("cat", ((F.lit(1.0) + F.col("n")) / F.lit(float(max(count + total, 1)))).alias("pr"))
    e = cut(e.join(e.groupBy("child").agg(F.count("*").alias("deg")), "child"))
    for _ in range(iterations):
        got = e.join(ranks, e.child == ranks.cat).groupBy(F.col("parent").alias("cat")).agg(F.sum(damping * F.col("pr") / F.col("deg")).alias("got"))
        ranks = cut(cats.select("cat").join(got, "cat", "left").select("cat", (F.lit((1 - damping) / max(count, 1)) + F.coalesce("got", F.lit(0.0))).alias("pr")))
    return ranks.withColumn("cost", 1 / -F.log("pr"))


def category_graph(members: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent) between categories and (cat, page_id) for other members, from (category_id, article_id) and (category_id)."""
    cats = categories.select(F.col("category_id").alias("__c")).distinct()
    known = members.join(cats, members.category_id == F.col("__c"), "left_semi")
    tagged = known.join(cats, known.article_id == F.col("__c"), "left")
    up = tagged.where("__c is not null").select(F.col("article_id").alias("child"), F.col("category_id").alias("parent"))
    return up, tagged.where("__c is null").select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))


def _rounds(most: int | None):
    """Numbers of rounds without end; beyond ``most`` an error, since what is found by then isn't the result."""
    for k in count(1):
        if most is not None and k > most:
            raise RuntimeError(f"not settled after {most} rounds")
        yield k


def relax(start: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, owner, dist): for each node the least (dist, owner) that reaches it from ``start`` over (src, dst, w), w > 0.

    Bellman-Ford rounds over the nodes that changed, until none does; equal distances go to the smaller owner. With
    ``rounds`` it is an error if more would be needed.
    """
    best = cut(start.groupBy("node").agg(F.min(F.struct("dist", "owner")).alias("b")).select("node", "b.owner", "b.dist"))
    front = best
    for _ in _rounds(rounds):
        seen = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), "owner", (F.col("dist") + F.col("w")).alias("dist"))
        cand = seen.groupBy("node").agg(F.min(F.struct("dist", "owner")).alias("c"))
        old = best.select("node", F.struct("dist", "owner").alias("b"))
        front = cut(cand.join(old, "node", "left").where("b is null or c < b").select("node", "c.owner", "c.dist"))
        if front.isEmpty():
            break
        best = cut(front.unionByName(best.join(front, "node", "left_anti")))
    return best


def closest_categories(candidates: DataFrame, child_parent: DataFrame, pages: DataFrame, costs: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(page_id, cat, dist): the candidate category nearest to each page, going down from parent to child.

    An edge costs what its child costs, 1 without ``costs``; a page has the cost of its nearest category.
    """
    w = child_parent.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    w = w.withColumn("w", F.lit(1.0)) if costs is None else w.join(costs.select(F.col("cat").alias("dst"), F.col("cost").alias("w")), "dst")
    reached = relax(candidates.select(F.col("cat").alias("node"), F.col("cat").alias("owner"), F.lit(0.0).alias("dist")), w, rounds)
    got = pages.join(reached, pages.cat == reached.node).groupBy("page_id").agg(F.min(F.struct("dist", "owner")).alias("b"))
    return got.select("page_id", F.col("b.owner").alias("cat"), F.col("b.dist").alias("dist"))


def category_distances(start_pages: DataFrame, child_parent: DataFrame, pages: DataFrame, costs: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(page_id, cat, dist) upward: every category above each of ``start_pages`` with its least distance; ``rounds`` as in relax()."""
    cost = None if costs is None else costs.select(F.col("cat").alias("__c"), "cost")
    up = child_parent.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    direct = start_pages.select("page_id").distinct().join(pages.distinct(), "page_id").select("page_id", "cat")
    if cost is None:
        up, best = up.withColumn("w", F.lit(1.0)), direct.withColumn("dist", F.lit(1.0))
    else:
        up = up.join(cost, F.col("dst") == F.col("__c")).select("src", "dst", F.col("cost").alias("w"))
        best = direct.join(cost, F.col("cat") == F.col("__c")).select("page_id", "cat", F.col("cost").alias("dist"))
    best = cut(best)
    front = best
    for _ in _rounds(rounds):
        cand = front.join(up, front.cat == up.src).groupBy("page_id", F.col("dst").alias("cat")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        old = best.select("page_id", "cat", F.col("dist").alias("d"))
        front = cut(cand.join(old, ["page_id", "cat"], "left").where("d is null or dist < d").select("page_id", "cat", "dist"))
        if front.isEmpty():
            break
        best = cut(front.unionByName(best.join(front, ["page_id", "cat"], "left_anti")))
    return best


def closest_category(distances: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, cat, dist): the nearest of the candidates, the least id in ties."""
    d = distances.join(candidates.select("cat").distinct(), "cat", "left_semi").groupBy("page_id").agg(F.min(F.struct("dist", "cat")).alias("b"))
    return d.select("page_id", "b.cat", "b.dist")


def category_similarity(pairs: DataFrame, distances: DataFrame, costs: DataFrame) -> DataFrame:
    """(a, b, distance, score) for pairs of pages that share a category above: least d1 + d2 - cost, as ln(d) / ln(least cost)."""
    a = distances.select(F.col("page_id").alias("a"), "cat", F.col("dist").alias("d1"))
    b = distances.select(F.col("page_id").alias("b"), "cat", F.col("dist").alias("d2"))
    met = pairs.join(a, "a").join(b, ["b", "cat"]).join(costs.select("cat", "cost"), "cat").groupBy("a", "b").agg(F.min(F.col("d1") + F.col("d2") - F.col("cost")).alias("distance"))
    low = costs.agg(F.min("cost").alias("low"))
    return pairs.join(met, ["a", "b"], "left").join(F.broadcast(low)).select("a", "b", "distance", F.when(F.col("distance").isNull(), 0.0).otherwise(F.log(F.greatest("distance", "low")) / F.log("low")).alias("score"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable over (a, b), edges taken as undirected.

    Large and small stars by turns, which takes few rounds whatever the diameter; nodes without edges stand alone.
    """

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = state(e)
        if now == before:
            break
        before = now
    every = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    every = (every if nodes is None else every.union(nodes.select("node"))).distinct()
    return every.join(e, every.node == e.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def split_component(edges: DataFrame, max_votes: int = 2, min_ratio: float = 0.5, lang_count: int | None = None) -> DataFrame:
    """Edges that an ambiguous component keeps, from (src, src_lang, dst, dst_lang).

    An edge stays if its source has at most ``max_votes`` targets in that language, its target is pointed at from
    enough languages, and from the source's language at most ``max_votes`` times.
    """
    out = edges.groupBy("src", "dst_lang").agg(F.countDistinct("dst").alias("out_votes"))
    ins = edges.groupBy("dst").agg(F.countDistinct("src_lang").alias("in_langs"))
    by = edges.groupBy("dst", "src_lang").agg(F.countDistinct("src").alias("in_votes"))
    j = edges.join(out, ["src", "dst_lang"]).join(ins, "dst").join(by, ["dst", "src_lang"])
    if lang_count is None:
        need = F.floor(min_ratio * F.lit(edges.select("src_lang").distinct().count()) - 1)
    else:
        need = F.lit(int(min_ratio * lang_count - 1))
    return j.where((F.col("out_votes") <= max_votes) & (F.col("in_langs") >= need) & (F.col("in_votes") <= max_votes)).select("src", "src_lang", "dst", "dst_lang")


def hops(start: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """(owner, node, hops): breadth-first from (owner, node), over undirected (a, b), at most ``most`` hops."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    seen = cut(start.select("owner", "node", F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, most + 1):
        new = front.join(both, front.node == both.a).select("owner", F.col("b").alias("node")).distinct().join(seen.select("owner", "node"), ["owner", "node"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def family(child_parent: DataFrame, cats: DataFrame, kind: str) -> DataFrame:
    """(cat, other): the children or parents of the asked categories (cat)."""
    here, there = {"child": ("parent", "child"), "parent": ("child", "parent")}[kind]
    return child_parent.select(F.col(here).alias("cat"), F.col(there).alias("other")).distinct().join(cats.select("cat").distinct(), "cat", "left_semi")


def category_pages(members: DataFrame, cats: DataFrame) -> DataFrame:
    """(cat, page_id): the pages right in the asked categories, from (cat, page_id)."""
    return members.join(cats.select("cat").distinct(), "cat", "left_semi").select("cat", "page_id").distinct()


def parent_ranks(child_parent: DataFrame, ranks: DataFrame) -> DataFrame:
    """(cat, most, most_parent, least, least_parent): each category's parents of highest and of lowest page rank, the smaller id in ties."""
    j = child_parent.distinct().join(ranks.select(F.col("cat").alias("parent"), "pr"), "parent")
    most, least = F.min(F.struct((-F.col("pr")).alias("pr"), "parent")), F.min(F.struct("pr", "parent"))
    g = j.groupBy(F.col("child").alias("cat")).agg(most.alias("m"), least.alias("l"))
    return g.select("cat", (-F.col("m.pr")).alias("most"), F.col("m.parent").alias("most_parent"), F.col("l.pr").alias("least"), F.col("l.parent").alias("least_parent"))


def top_level(members: DataFrame, pages: DataFrame, root: DataFrame) -> DataFrame:
    """(lang_id, page_id): the categories right below each language's top (lang_id, category_id), from (lang_id, category_id, article_id)."""
    below = members.join(root, ["lang_id", "category_id"], "left_semi").select("lang_id", F.col("article_id").alias("page_id")).distinct()
    return below.join(pages.where("name_space = 14").select("lang_id", "page_id"), ["lang_id", "page_id"], "left_semi")


def category_search(start_pages: DataFrame, child_parent: DataFrame, members: DataFrame, costs: DataFrame | None = None, most: int | None = None, valid: DataFrame | None = None, children: bool = True) -> DataFrame:
    """(start, page_id, dist): pages nearest to each start page by paths of categories that go up and then down.

    Entering a category costs what it costs, 1 without ``costs``; a page is as far as the nearest of its categories, the start
    itself 0. With ``children`` off paths only go up. ``valid`` (page_id) bounds the pages, ``most`` their number for each start,
    the smaller id first in ties. Distances are relaxed from both directions until none changes.
    """
    up = category_distances(start_pages, child_parent, members, costs).select(F.col("page_id").alias("start"), "cat", "dist")
    best = cut(up)
    down = child_parent.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    down = down.withColumn("w", F.lit(1.0)) if costs is None else down.join(costs.select(F.col("cat").alias("dst"), F.col("cost").alias("w")), "dst")
    front = best
    while children and not front.isEmpty():
        cand = front.join(down, front.cat == down.src).groupBy("start", F.col("dst").alias("cat")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        old = best.select("start", "cat", F.col("dist").alias("d"))
        front = cut(cand.join(old, ["start", "cat"], "left").where("d is null or dist < d").select("start", "cat", "dist"))
        best = cut(front.unionByName(best.join(front, ["start", "cat"], "left_anti")))
    found = best.join(members.select("cat", "page_id"), "cat").groupBy("start", "page_id").agg(F.min("dist").alias("dist")).where("start <> page_id")
    found = found if valid is None else found.join(valid.select("page_id").distinct(), "page_id", "left_semi")
    found = found.select("start", "page_id", "dist").unionByName(start_pages.select(F.col("page_id").alias("start"), "page_id", F.lit(0.0).alias("dist")).distinct())
    return found if most is None else top(found, most, [F.asc("dist"), F.asc("page_id")], ["start"]).select("start", "page_id", "dist")
