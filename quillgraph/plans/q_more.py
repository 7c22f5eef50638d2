"""Queries over filters, hooks, categories, senses, scores and shapes: each operator that no other module's query runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranking
from ..functions import text as T
from ..operators import concepts, ensemble, esa, evaluate, filters, graph, knn, links, normalize, pageviews, phrases, similarity, spatial, wikidata, wikify
from ..session import table
from . import bind as B
from .bind import r
from .catalogue import query
from .q_graph import _M, DENSE, _boxes, _vectors
from .q_links import CUST, customer_graph
from .q_other import _G, GOLD, STACK, _entities, _gold, _guesses, _stacked
from .q_text import COUNTS, INDEX, _counts

# filters and hooks -------------------------------------------------------------------------------------------------------


@query(f"WITH {B.PAGES} SELECT page_id, name_space IN (0, 14) AND NOT is_redirect AS valid FROM pages")
def valid_pages(spark, d):
    return B.pages(spark, d).select("page_id", filters.valid_page(filters.PageFilter(name_spaces=[0, 14], is_redirect=False)).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END)::INTEGER AS location FROM lineitem")
def link_places(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", filters.location_class(F.col("l_linenumber") % 3, F.col("l_linenumber") % 2).alias("location"))


@query("""SELECT p_partkey AS page_id, (CASE p_partkey % 5 WHEN 0 THEN 14 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE 6 END)::INTEGER AS name_space, p_partkey % 5 = 1 AS talk FROM part""")
def name_spaces(spark, d):
    """Namespaces by name in any spelling, and which of them are talk pages."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, " Category ").when(k == 1, "USER_TALK").when(k == 2, "article").when(k == 3, "no such").otherwise("Image")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), filters.namespace_of(name).cast("int").alias("name_space"))
    return n.withColumn("talk", F.coalesce(filters.is_talk(F.col("name_space")), F.lit(False)))


@query(f"WITH {B.POINTS} SELECT id, CASE WHEN lon <> floor(lon) OR lat <> floor(lat) THEN 'HIGH' ELSE 'LOW' END AS precision FROM points")
def point_precisions(spark, d):
    return B.points(spark, d).select("id", filters.point_precision(F.col("lon"), F.col("lat")).alias("precision"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber NOT IN (1, 2, 3) AS real FROM lineitem")
def real_numbers(spark, d):
    n = F.col("l_linenumber")
    x = F.when(n == 1, float("nan")).when(n == 2, float("-inf")).when(n > 3, F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", filters.is_real(x).alias("real"))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.07")
def pruned_range(spark, d):
    return filters.prune_range(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", 0.02, 0.07)


@query("SELECT l_orderkey, l_linenumber, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS kept FROM lineitem")
def kept_and_dropped(spark, d):
    """Rows whose id is in a set, and the others: together all."""
    ids = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    kept, gone = filters.keep_ids(t, ids, "l_suppkey"), filters.drop_ids(t, ids, "l_suppkey")
    return kept.select("l_orderkey", "l_linenumber", F.lit(True).alias("kept")).unionByName(gone.select("l_orderkey", "l_linenumber", F.lit(False).alias("kept")))


@query("SELECT l_orderkey AS row_id, l_partkey AS col_id, round(sum(l_discount) * 2 - 0.1, 6) AS value FROM lineitem GROUP BY ALL HAVING round(sum(l_discount) * 2 - 0.1, 6) > 0")
def mapped_features(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_discount").alias("value"))
    x = F.round(F.col("value") * 2 - 0.1, 6)
    return filters.map_features(v, F.when(x > 0, x))


@query(f"WITH {B.CONCEPTS}, l AS (SELECT univ_id, list_distinct(list(lang_id)) AS langs FROM concepts GROUP BY ALL) SELECT univ_id, list_has_any(langs, [1, 3]) AS some, list_has_all(langs, [1, 3]) AS both FROM l")
def concept_languages(spark, d):
    c = B.concepts(spark, d).groupBy("univ_id").agg(F.collect_set("lang_id").alias("langs"))
    want = F.array(F.lit(1), F.lit(3))
    return c.select("univ_id", filters.in_language_set(F.col("langs"), want).alias("some"), filters.in_language_set(F.col("langs"), want, every=True).alias("both"))


@query("SELECT p_partkey::INTEGER AS entity_id, p_size::VARCHAR AS val_str FROM part WHERE p_size IN (3, 5, 7)")
def statement_scan(spark, d):
    f = filters.StatementFilter(entity_types=["Q"], prop_ids=[31], ranks=[1], values=["3", "5", "7"])
    return f.apply(wikidata.statements(_entities(spark, d))).select("entity_id", "val_str")


@query(f"WITH {B.VIEWS} SELECT lang_id, page_id, tstamp, num_views FROM views WHERE lang_id = 1 AND num_views BETWEEN 1 AND 2 AND tstamp >= TIMESTAMP '2024-01-05' AND tstamp < TIMESTAMP '2024-01-12'")
def view_scan(spark, d):
    f = filters.ViewFilter(langs=[1], min_views=1, max_views=2, start="2024-01-05 00:00:00", end="2024-01-12 00:00:00", half_open=True)
    return f.apply(B.views(spark, d)).select("lang_id", "page_id", "tstamp", "num_views")


# inter-language links, views, concepts ---------------------------------------------------------------------------------------

ILLS = "ills AS MATERIALIZED (SELECT (p_partkey % 4 + 1)::INTEGER AS source_lang, p_partkey AS source_id, ((p_partkey + 1) % 4 + 1)::INTEGER AS dest_lang, p_partkey + 1 AS dest_id FROM part UNION ALL SELECT (p_partkey % 4 + 1)::INTEGER, p_partkey, 1, p_partkey + 100000 FROM part)"


def _ills(spark, d):
    k = F.col("p_partkey")
    p, lang = table(spark, d, "part"), lambda x: (x % 4 + 1).cast("int")
    cols = lambda dest_lang, dest: (lang(k).alias("source_lang"), k.alias("source_id"), dest_lang.alias("dest_lang"), dest.alias("dest_id"))
    return p.select(*cols(lang(k + 1), k + 1)).unionByName(p.select(*cols(F.lit(1), k + 100_000)))


@query(f"WITH {B.PAGES}, {ILLS} SELECT source_lang, source_id, dest_lang, dest_id FROM ills SEMI JOIN pages a ON a.lang_id = source_lang AND a.page_id = source_id SEMI JOIN pages b ON b.lang_id = dest_lang AND b.page_id = dest_id WHERE dest_lang IN (1, 2)")
def inter_language_links(spark, d):
    return links.valid_inter_language(_ills(spark, d), B.pages(spark, d), [1, 2]).select("source_lang", "source_id", "dest_lang", "dest_id")


@query(f"""WITH {B.CONCEPTS}, {ILLS} SELECT source_lang, source_id, dest_lang, dest_id FROM ills UNION SELECT a.lang_id, a.page_id, b.lang_id, b.page_id FROM concepts a JOIN concepts b USING (univ_id) WHERE a.lang_id <> b.lang_id""")
def sibling_links(spark, d):
    return links.with_sibling_links(_ills(spark, d), B.concepts(spark, d))


@query("SELECT ((p_partkey % 4) + 1)::INTEGER AS lang_id, p_partkey AS page_id, date_trunc('hour', ts) AS tstamp, count(*) AS num_views FROM events JOIN part ON p_partkey = user_id GROUP BY ALL")
def matched_views(spark, d):
    """Raw views by title get their page; titles without one go."""
    k = F.col("user_id")
    p = B.pages(spark, d).select("lang_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "page_id")
    raw = table(spark, d, "events").select((k % 4 + 1).cast("int").alias("lang_id"), F.concat(F.lit("Page "), k.cast("string")).alias("title"), F.date_trunc("hour", "ts").alias("tstamp"), F.lit(1).cast("long").alias("num_views"))
    return pageviews.match_titles(raw, p)


@query(f"WITH {B.PAGES} SELECT lang_id, page_id, name_space, lang_id::BIGINT * 4294967296 + page_id AS univ_id FROM pages")
def monolingual_concepts(spark, d):
    return concepts.monolingual(B.pages(spark, d))


@query(f"""WITH {B.CONCEPTS}, {B.LINKS}, t AS (SELECT univ_id, min(page_id) AS there FROM concepts WHERE lang_id = 2 GROUP BY ALL)
SELECT DISTINCT c.page_id, l.dest_id FROM concepts c JOIN t USING (univ_id) JOIN links l ON l.lang_id = 2 AND l.source_id = t.there""")
def links_abroad(spark, d):
    """What the page of the same concept in another language links to."""
    c = B.concepts(spark, d)
    return concepts.linked_abroad(c.select("lang_id", "page_id"), c, B.links(spark, d), 2)


# categories --------------------------------------------------------------------------------------------------------------

CATS = f"{B.TREE}, mem AS MATERIALIZED (SELECT DISTINCT p_size::BIGINT AS cat, p_partkey AS page_id FROM part)"


def _members(spark, d):
    return B.members(spark, d).select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))


@query(f"""WITH {B.PAGES}, m AS (SELECT p_size::BIGINT * 10 AS category_id, p_partkey AS article_id FROM part), c AS (SELECT page_id FROM pages WHERE name_space = 14), k AS (SELECT m.* FROM m SEMI JOIN c ON c.page_id = category_id)
SELECT category_id, article_id, c.page_id IS NOT NULL AS is_category FROM k LEFT JOIN c ON c.page_id = article_id""")
def category_links(spark, d):
    """Members of categories, categories and pages apart."""
    m = table(spark, d, "part").select((F.col("p_size") * 10).cast("long").alias("category_id"), F.col("p_partkey").alias("article_id"))
    up, pages = graph.category_graph(m, B.pages(spark, d).where("name_space = 14").select(F.col("page_id").alias("category_id")))
    return up.select(F.col("parent").alias("category_id"), F.col("child").alias("article_id"), F.lit(True).alias("is_category")).unionByName(pages.select(F.col("cat").alias("category_id"), F.col("page_id").alias("article_id"), F.lit(False).alias("is_category")))


@query(f"""WITH {CATS} SELECT 'child' AS kind, parent AS cat, child AS other FROM tree WHERE parent % 2 = 0 UNION ALL SELECT 'parent', child, parent FROM tree WHERE child % 2 = 0 UNION ALL SELECT 'page', cat, page_id FROM mem WHERE cat % 2 = 0""")
def category_family(spark, d):
    tree, m = B.category_tree(spark, d), _members(spark, d)
    cats = m.select("cat").union(tree.select("child")).union(tree.select("parent")).distinct().where("cat % 2 = 0")
    out = graph.category_pages(m, cats).select(F.lit("page").alias("kind"), "cat", F.col("page_id").alias("other"))
    for kind in ("child", "parent"):
        out = out.unionByName(graph.family(tree, cats, kind).select(F.lit(kind).alias("kind"), "cat", "other"))
    return out


@query(f"""WITH {CATS}, p AS (SELECT cat AS parent, count(*)::DOUBLE AS pr FROM mem GROUP BY ALL), j AS (SELECT child, parent, pr FROM tree JOIN p USING (parent))
SELECT child AS cat, max(pr) AS most, arg_min(parent, (-pr, parent)) AS most_parent, min(pr) AS least, arg_min(parent, (pr, parent)) AS least_parent FROM j GROUP BY ALL""")
def category_parent_ranks(spark, d):
    ranks = _members(spark, d).distinct().groupBy("cat").agg(F.count("*").cast("double").alias("pr"))
    return graph.parent_ranks(B.category_tree(spark, d), ranks)


UPWARD = f"""{CATS}, reach AS (SELECT page_id, cat, 1 AS dist FROM mem UNION SELECT page_id, parent, dist + 1 FROM reach JOIN tree ON child = cat WHERE child <> parent AND dist < 30), ups AS MATERIALIZED (SELECT page_id, cat, min(dist) AS dist FROM reach GROUP BY ALL)"""


@query(f"WITH RECURSIVE {UPWARD} SELECT page_id, arg_min(cat, (dist, cat)) AS cat, min(dist)::DOUBLE AS dist FROM ups WHERE cat IN (2, 3, 5, 7) GROUP BY ALL")
def nearest_of_candidates(spark, d):
    """The nearest of some categories above each page."""
    m = _members(spark, d)
    up = graph.category_distances(m, B.category_tree(spark, d), m)
    return graph.closest_category(up, spark.createDataFrame([(2,), (3,), (5,), (7,)], "cat long"))


@query(f"""WITH RECURSIVE {UPWARD}, p AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part), c AS (SELECT cat, 0.5::DOUBLE + 1.0::DOUBLE / cat AS cost FROM (SELECT child AS cat FROM tree UNION SELECT parent FROM tree UNION SELECT cat FROM mem)),
m AS (SELECT a, b, min(x.dist + y.dist - cost) AS distance FROM p JOIN ups x ON x.page_id = a JOIN ups y ON y.page_id = b AND y.cat = x.cat JOIN c ON c.cat = x.cat GROUP BY ALL), low AS (SELECT min(cost) AS low FROM c)
SELECT p.a, p.b, round(distance, 6) AS distance, round(CASE WHEN distance IS NULL THEN 0 ELSE ln(greatest(distance, low)) / ln(low) END, 6) AS score FROM p LEFT JOIN m USING (a, b) CROSS JOIN low""")
def category_relatedness(spark, d):
    """How near pages are by the categories above both."""
    m, tree = _members(spark, d), B.category_tree(spark, d)
    cats = m.select("cat").union(tree.select("child")).union(tree.select("parent")).distinct()
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    got = graph.category_similarity(pairs, graph.category_distances(m, tree, m), cats.select("cat", (F.lit(0.5) + F.lit(1.0) / F.col("cat")).alias("cost")))
    return got.select("a", "b", r("distance"), r("score"))


@query(f"""WITH RECURSIVE {UPWARD}, s AS (SELECT page_id AS start, cat, dist FROM ups WHERE page_id % 20 = 0), dn AS (SELECT start, cat, dist FROM s UNION SELECT start, child, dist + 1 FROM dn JOIN tree ON parent = cat WHERE child <> parent AND dist < 30),
f AS (SELECT start, page_id, min(dist)::DOUBLE AS dist FROM dn JOIN mem USING (cat) WHERE start <> page_id AND page_id % 3 > 0 GROUP BY ALL UNION ALL SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 20 = 0)
SELECT start, page_id, dist FROM f QUALIFY row_number() OVER (PARTITION BY start ORDER BY dist, page_id) <= 25""")
def category_neighbours(spark, d):
    """The 25 pages nearest to every twentieth one by categories, up and then down."""
    m, p = _members(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    return graph.category_search(p.where("page_id % 20 = 0"), B.category_tree(spark, d).where("child <> parent"), m, most=25, valid=p.where("page_id % 3 > 0"))


@query(f"WITH {B.PAGES} SELECT DISTINCT q.lang_id, p_partkey AS page_id FROM part JOIN pages q ON q.page_id = p_partkey WHERE name_space = 14 AND q.lang_id = q.p_size AND part.p_size <= 4")
def top_categories(spark, d):
    """The categories right below each language's top one."""
    m = table(spark, d, "part").select((F.col("p_partkey") % 4 + 1).cast("int").alias("lang_id"), F.col("p_size").cast("long").alias("category_id"), F.col("p_partkey").alias("article_id"))
    return graph.top_level(m, B.pages(spark, d), spark.createDataFrame([(k, k) for k in (1, 2, 3, 4)], "lang_id int, category_id long"))


# scores and lists ----------------------------------------------------------------------------------------------------------

DIRECT = f"{CUST}, dl AS MATERIALIZED (SELECT a, b, count(*) / 2.0::DOUBLE AS score FROM (SELECT source_id AS a, dest_id AS b FROM ce UNION ALL SELECT dest_id, source_id FROM ce) WHERE a <> b GROUP BY ALL)"


def _direct(spark, d):
    return similarity.direct_link(customer_graph(spark, d))


@query(f"WITH {DIRECT}, x AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 20 = 0), y AS (SELECT n_nationkey::BIGINT AS id FROM nation) SELECT x.id AS a, y.id AS b, (CASE WHEN x.id = y.id THEN 1 ELSE coalesce(score, 0) END)::DOUBLE AS score FROM x CROSS JOIN y LEFT JOIN dl ON dl.a = x.id AND dl.b = y.id")
def cosimilarity_matrix(spark, d):
    """All pairs of two stated lists."""
    x, y = table(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("id")), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return similarity.cosimilarity(_direct(spark, d), x, y)


@query(f"""WITH {_G}, a AS (SELECT DISTINCT q, id FROM (SELECT q, id FROM g WHERE id % 20 = 0 UNION ALL SELECT DISTINCT q, -1 FROM g)) SELECT a.q, a.id, k.rank::INTEGER AS rank, round(gain, 6) AS score FROM a LEFT JOIN (SELECT q, id, gain, row_number() OVER (PARTITION BY q ORDER BY gain DESC, id) AS rank FROM g) k USING (q, id)""")
def positions(spark, d):
    """Rank and score of asked ids in their lists; null for those that aren't there."""
    g = _guesses(spark, d).select("q", "id", F.col("gain").alias("score"))
    asked = g.where("id % 20 = 0").select("q", "id").union(g.select("q", F.lit(-1).cast("long")).distinct())
    return ranking.position(g, asked, "q", "id").select("q", "id", "rank", r("score"))


@query(f"""WITH {GOLD}, o AS (SELECT lang, score, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score, gold, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, gold FROM gold),
c AS (SELECT lang, score, i, n FROM o WHERE i >= 5 AND i < n - 5 AND (i - 5) % greatest(1, n // 13) = 0), w AS (SELECT c.lang, c.score, c.i, o.gold AS y, row_number() OVER (PARTITION BY c.lang, c.i ORDER BY o.gold) - 1 AS k, count(*) OVER (PARTITION BY c.lang, c.i) AS m FROM c JOIN o ON o.lang = c.lang AND o.i BETWEEN c.i - 5 AND c.i + 9),
e AS (SELECT lang, score, i, y, exp(-((k - m // 2) ^ 2) / (2.0::DOUBLE * greatest(3, m // 4) ^ 2)) AS g FROM w), p AS (SELECT lang, score, i, sum(y * g) / sum(g) AS y FROM e GROUP BY ALL)
SELECT lang, score, round(avg(y), 6) AS gold FROM p GROUP BY ALL""")
def smoothed_scores(spark, d):
    """Curves of a dozen points for each language, by robust means."""
    return ranking.smooth_robust(_gold(spark, d), "score", "gold", ["lang"], 10, 12).select("lang", "score", r("gold"))


@query(f"""WITH {GOLD}, s AS (SELECT lang, source, sum(score) AS value FROM gold GROUP BY ALL), n AS (SELECT lang, source, value / sum(value) OVER (PARTITION BY lang) AS value FROM s)
SELECT lang, arg_min(source, (-round(value, 9), source)) AS source, round(max(value), 6) AS value, round(max(value) / any_value(length(lang)), 6) AS divided FROM n GROUP BY lang""")
def summed_maps(spark, d):
    """Sums as shares of their group, the largest of each, and divided by a weight."""
    s = _gold(spark, d).groupBy("lang", "source").agg(F.sum("score").alias("value"))
    n = ranking.normalised(s, ["lang"])
    best = ranking.largest(n.withColumn("value", F.round("value", 9)), ["lang"], "source").drop("value").join(n, ["lang", "source"])
    weights = n.select("lang", F.char_length("lang").cast("double").alias("weight")).distinct()
    divided = ranking.divided(best, weights, ["lang"]).select("lang", F.col("value").alias("divided"))
    return best.join(divided, "lang").select("lang", "source", r("value"), r("divided"))


@query(f"WITH {B.EDGES}, v AS (SELECT source_id AS row_id, dest_id AS col_id, 1.0::DOUBLE AS value FROM e) SELECT col_id AS row_id, row_id AS col_id, value FROM v UNION ALL SELECT row_id, col_id + 2147483648, value * 0.5::DOUBLE FROM v")
def concatenated_vectors(spark, d):
    """Link vectors of both directions in one space."""
    v = similarity.link_vectors(B.edges(spark, d))
    return similarity.concatenate([(similarity.transpose(v), 1.0), (v, 0.5)])


@query("SELECT vec_id AS id, round(list_sum([(x::DOUBLE + 2 * x::DOUBLE) ^ 2 for x in embedding]), 4) AS square FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")
def vector_sums(spark, d):
    v = _vectors(spark, d).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    e = F.transform("embedding", lambda x: x.cast("double"))
    s = knn.add(e, knn.scale(e, 2.0))
    return v.select("id", F.round(similarity.dot_dense(s, s), 4).alias("square"))


@query(f"WITH {DENSE}, t AS (SELECT query_id, id, score FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5) SELECT query_id AS row_id, id AS col_id, round(score, 6) AS value FROM t WHERE score > 0")
def neighbour_vectors(spark, d):
    """Lists of nearest ones as vectors."""
    v = _vectors(spark, d)
    n = knn.brute_force(v, v.where("id % 20 = 0"), 5).select(F.col("query_id").alias("a"), "rank", F.col("id").alias("b"), "score")
    return esa.concept_vectors(n).select("row_id", "col_id", r("value"))


@query(f"""WITH {B.EDGES}, v AS (SELECT source_id AS row_id, dest_id AS col_id, 1.0::DOUBLE AS value FROM e), a AS (SELECT * FROM v WHERE row_id % 2 = 0), b AS (SELECT row_id, col_id, 2.0::DOUBLE AS value FROM v WHERE row_id % 3 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE row_id NOT IN (SELECT row_id FROM a)""")
def first_vectors(spark, d):
    """Each row's vector from the first table that has one."""
    v = similarity.link_vectors(B.edges(spark, d))
    return esa.best_of(v.where("row_id % 2 = 0"), v.where("row_id % 3 = 0").withColumn("value", F.lit(2.0)))


@query(f"""WITH {COUNTS}, s AS (SELECT phrase, page_id, count::DOUBLE AS score FROM c), u AS (SELECT phrase, page_id, sum(score * 0.5) AS s FROM (SELECT * FROM s UNION ALL SELECT phrase, page_id, 1 FROM s WHERE page_id < 30) GROUP BY ALL),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY s DESC, page_id) <= 6), w AS (SELECT phrase, page_id, sqrt(s / sum(s) OVER (PARTITION BY phrase)) AS v FROM b)
SELECT phrase, page_id AS col_id, round(v, 6) AS value FROM w""")
def phrase_vector_store(spark, d):
    """Phrases as vectors of their candidates, kept in a store that a second run doesn't change."""
    s = _counts(spark, d).select("phrase", "page_id", F.col("count").cast("double").alias("score"))
    both = s.withColumn("weight", F.lit(0.5)).unionByName(s.where("page_id < 30").select("phrase", "page_id", F.lit(1.0).alias("score"), F.lit(0.5).alias("weight")))
    fresh = similarity.phrase_vectors(both, 6).select("phrase", F.col("page_id").alias("col_id"), F.col("weight").alias("value"))
    store = esa.known_phrases(None, fresh)
    return esa.known_phrases(store, fresh.withColumn("value", F.lit(9.0))).select("phrase", "col_id", r("value"))


# normalizers, ensembles and evaluation --------------------------------------------------------------------------------------

_LINE = "x AS (SELECT *, ln(1 + row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)) AS lr, ln(1 + score) AS ls FROM gold), m AS (SELECT var_pop(lr) AS vr, var_pop(ls) AS vs, covar_pop(lr, ls) AS rs, covar_pop(lr, gold) AS rg, covar_pop(ls, gold) AS sg, avg(lr) AS ar, avg(ls) AS asc_, avg(gold) AS ag FROM x), b AS (SELECT (vs * rg - rs * sg) / (vr * vs - rs * rs) AS br, (vr * sg - rs * rg) / (vr * vs - rs * rs) AS bs, ar, asc_, ag FROM m)"


@query(f"WITH {GOLD}, {_LINE} SELECT doc_id, round(ag + br * (lr - ar) + bs * (ls - asc_), 5) AS score FROM x, b")
def rank_and_score_normalized(spark, d):
    """Gold scores as a linear function of the logarithms of rank and score."""
    g = _gold(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")))
    n = normalize.RankAndScore(log=True).fit(g, "rank", "score", "gold")
    return g.select("doc_id", F.round(n.apply(F.col("rank"), F.col("score")), 5).alias("score"))


@query(f"""WITH {STACK}, s AS (SELECT 'quantity' AS metric, CASE WHEN q > 10 THEN q END AS score, NULL::INTEGER AS rank, gold FROM t UNION ALL SELECT 'discount', CASE WHEN x > 2 THEN x END, row_number() OVER (PARTITION BY a ORDER BY x DESC, b), gold FROM t),
f AS (SELECT metric, coalesce(avg(gold) FILTER (score IS NULL), min(score)) AS s, greatest(100.0::DOUBLE, 1.25::DOUBLE * coalesce(max(rank), 0)) AS r FROM s GROUP BY ALL)
SELECT s.metric, round(coalesce(score, f.s), 4) AS score, round(coalesce(rank, f.r), 4) AS rank, count(*) AS n FROM s JOIN f USING (metric) GROUP BY ALL""")
def interpolated_scores(spark, d):
    """What stands for the scores and ranks that metrics lack."""
    t, _ = _stacked(spark, d)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("x"), "b"))
    s = t.select(F.lit("quantity").alias("metric"), F.when(F.col("q") > 10, F.col("q")).alias("score"), F.lit(None).cast("int").alias("rank"), "gold").unionByName(t.select(F.lit("discount").alias("metric"), F.when(F.col("x") > 2, F.col("x")).alias("score"), place.alias("rank"), "gold"))
    return normalize.Interpolator().fit(s).apply(s).groupBy("metric", F.round("score", 4).alias("score"), F.round("rank", 4).alias("rank")).agg(F.count("*").alias("n"))


@query(f"""WITH {GOLD}, h AS (SELECT doc_id, ('0x' || substr(md5('3' || chr(1) || doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold, gold, score FROM gold), l AS (SELECT f.fold, min(h.score) AS a, max(h.score) AS b FROM (SELECT DISTINCT fold FROM h) f JOIN h ON h.fold <> f.fold GROUP BY ALL),
s AS (SELECT h.fold, gold, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score - a) / (b - a))) AS score FROM h JOIN l USING (fold)), e AS (SELECT fold, gold, score FROM s UNION ALL SELECT NULL, gold, score FROM s)
SELECT fold::INTEGER AS fold, count(*) AS n, round(corr(score, gold), 6) AS pearson, round(avg(abs(score - gold)), 6) AS mae, round(sqrt(avg((score - gold) ^ 2)), 6) AS rmse FROM e GROUP BY fold""")
def cross_validated(spark, d):
    """Five folds, each scored by a normalizer trained on the others."""

    def fit(rows):
        n = normalize.train(rows.select("doc_id", F.col("gold").alias("similarity")), rows.select("doc_id", "score"), normalize.Range(), ["doc_id"])
        return lambda df: df.withColumn("score", n.apply(F.col("score")))

    got = evaluate.k_fold(_gold(spark, d), fit, 5, ("doc_id",), 3)
    return got.select("fold", "n", r("pearson"), r("mae"), r("rmse"))


@query(f"""WITH {STACK}, q AS (SELECT a, b, q AS score, row_number() OVER (PARTITION BY a ORDER BY round(q, 9) DESC, b) AS rank FROM t), x AS (SELECT a, b, x AS score, row_number() OVER (PARTITION BY a ORDER BY round(x, 9) DESC, b) AS rank FROM t),
c AS (SELECT a, b FROM q WHERE rank <= 20 UNION SELECT a, b FROM x WHERE rank <= 20), w AS (SELECT a, b, round((3 * q + x) / 4, 6) AS score FROM t SEMI JOIN c USING (a, b))
SELECT a, row_number() OVER w2::INTEGER AS rank, b, score FROM w WINDOW w2 AS (PARTITION BY a ORDER BY score DESC, b) QUALIFY row_number() OVER w2 <= 10""")
def weighted_list_ensemble(spark, d):
    """Lists of several metrics as one: the first of each are scored anew by all."""
    t, _ = _stacked(spark, d)
    lists = lambda c: similarity.most_similar(t.select("a", "b", F.col(c).alias("score")), 20)
    stacked = ensemble.stack({"quantity": lists("q"), "discount": lists("x")})
    scores = ensemble.stack({"quantity": t.select("a", "b", (F.col("q") * 1).alias("score")), "discount": t.select("a", "b", F.col("x").alias("score"))})
    w = ensemble.weighted(scores.join(stacked.where("rank <= 20").select("a", "b").distinct(), ["a", "b"], "left_semi"), {"quantity": 3.0, "discount": 1.0})
    return ensemble.even_lists(ensemble.stack({"all": w.withColumn("score", F.round("score", 6))}), 1, 10)


def _list_gold(spark, d):
    g = _guesses(spark, d)
    return g.where("rank <= 30").select("q", "id", "rank"), g.where("id % 3 > 0").select("q", "id", "gain")


SEEN = f"""{_G}, gs AS (SELECT q, id, rank FROM g WHERE rank <= 30), gd AS (SELECT q, id, gain FROM g WHERE id % 3 > 0)"""
NDCG = """{0}s AS (SELECT x.q, x.id, x.rank, y.gain FROM {1} x JOIN {2} y USING (q, id)), {0}p AS (SELECT q, id, rank, gain, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS place, row_number() OVER (PARTITION BY q ORDER BY gain DESC, id) AS best FROM {0}s),
{0}n AS (SELECT a.q, sum(a.gain * CASE WHEN a.rank = 1 THEN 1 ELSE 1 / ln(a.rank + 1) END) / sum(a.gain * CASE WHEN b.rank = 1 THEN 1 ELSE 1 / ln(b.rank + 1) END) AS ndcg, count(*) AS n FROM {0}p a JOIN {0}p b ON b.q = a.q AND b.place = a.best GROUP BY ALL)"""
PENAL = """z AS (SELECT q, max(rank) AS len FROM gs GROUP BY ALL), ev AS (SELECT q, id, rank FROM gs UNION ALL SELECT gd.q, gd.id, 3 * len FROM gd ANTI JOIN gs USING (q, id) JOIN z USING (q)), lw AS (SELECT q, id, gain - min(gain) OVER (PARTITION BY q) / 2 AS gain FROM gd)"""


@query(f"WITH {SEEN}, {PENAL}, {NDCG.format('k', 'ev', 'lw')} SELECT q, round(ndcg, 6) AS ndcg, n FROM kn")
def penalised_list_evaluation(spark, d):
    """Lists against other judgements; judged ids that a list lacks count at three times its length."""
    return evaluate.penalised_ndcg(*_list_gold(spark, d)).select("q", r("ndcg"), "n")


@query(f"""WITH {SEEN}, {PENAL}, {NDCG.format('j', 'gs', 'gd')}, {NDCG.format('k', 'ev', 'lw')}, v(k) AS (VALUES (1), (5), (10), (20), (50), (100), (500), (1000)), t AS (SELECT q, nullif(sum((gain >= 0.08)::INTEGER), 0) AS total FROM gd GROUP BY q),
pr AS (SELECT js.q, k, avg((gain >= 0.08)::INTEGER) AS precision, sum((gain >= 0.08)::INTEGER)::DOUBLE / any_value(total) AS recall FROM js JOIN t USING (q) CROSS JOIN v WHERE rank <= k GROUP BY js.q, k)
SELECT 'precision' AS measure, k::INTEGER AS at, round(avg(precision), 6) AS value FROM pr GROUP BY k UNION ALL SELECT 'recall', k, round(avg(recall), 6) FROM pr GROUP BY k UNION ALL SELECT 'ndcg', NULL, round(sum(ndcg * (n - 1)) / sum(n - 1), 6) FROM jn
UNION ALL SELECT 'penalised ndcg', NULL, round(sum(ndcg * (n - 1)) / sum(n - 1), 6) FROM kn UNION ALL SELECT 'judged', NULL, count(*) FROM js""")
def list_report(spark, d):
    """All measures of lists at once."""
    return evaluate.most_similar_report(*_list_gold(spark, d), threshold=0.08).select("measure", "at", r("value"))


@query(f"""WITH {GOLD}, k AS (SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE - rank() OVER (PARTITION BY lang ORDER BY gold) - (count(*) OVER (PARTITION BY lang, gold) - 1) / 2.0::DOUBLE AS difference FROM gold)
SELECT lang, doc_id, difference FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY abs(difference) DESC, doc_id) <= 5""")
def worst_scores(spark, d):
    """Where ranks by score and by gold differ most."""
    return evaluate.worst(_gold(spark, d).select("doc_id", "lang", "score", "gold"), ["lang"], 5).select("lang", "doc_id", "difference")


# senses -------------------------------------------------------------------------------------------------------------------

RES = f"{COUNTS}, rs AS MATERIALIZED (SELECT phrase, page_id, count::DOUBLE / sum(count) OVER (PARTITION BY phrase) AS prob, row_number() OVER (PARTITION BY phrase ORDER BY count DESC, page_id) AS rank FROM c)"
#: Pages of one first digit are related, the more the nearer they are.
RELATED = "rel AS MATERIALIZED (SELECT x.page_id AS a, y.page_id AS b, 1.0::DOUBLE / (1 + abs(x.page_id - y.page_id)) AS score FROM (SELECT DISTINCT page_id FROM c) x JOIN (SELECT DISTINCT page_id FROM c) y ON x.page_id // 10 = y.page_id // 10 AND x.page_id <> y.page_id)"


def _resolved(spark, d, k=10):
    return phrases.resolve(_counts(spark, d), k)


def _related(spark, d):
    p = _counts(spark, d).select("page_id").distinct()
    j = p.select(F.col("page_id").alias("a"), F.floor(F.col("page_id") / 10).alias("k")).join(p.select(F.col("page_id").alias("b"), F.floor(F.col("page_id") / 10).alias("k")), "k").where("a <> b")
    return j.select("a", "b", (F.lit(1.0) / (1 + F.abs(F.col("a") - F.col("b")))).alias("score"))


@query(f"WITH {RES} SELECT phrase, page_id, round(prob, 6) AS prob FROM rs WHERE rank = 1")
def top_senses(spark, d):
    return phrases.top_sense(_resolved(spark, d)).select("phrase", "page_id", r("prob"))


@query(f"WITH {COUNTS}, {B.PAGES}, p AS (SELECT DISTINCT phrase FROM c), t AS (SELECT lower(split_part(p_type, ' ', 1)) AS title, p_partkey AS page_id FROM part) SELECT phrase, page_id, 1.0::DOUBLE AS prob FROM p JOIN t ON title = phrase")
def title_senses(spark, d):
    t = table(spark, d, "part").select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("title"), F.col("p_partkey").alias("page_id"))
    return phrases.by_title(_counts(spark, d).select("phrase").distinct(), t)


#: Contexts are the words of a part's name.
CONTEXT = "cx AS MATERIALIZED (SELECT DISTINCT p_partkey AS ctx, lower(unnest(string_split(p_name, ' '))) AS phrase FROM part)"


def _contexts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("ctx"), F.explode(F.split(F.lower("p_name"), " ")).alias("phrase")).distinct()


BY_SIM = f"""{RES}, {RELATED}, {CONTEXT}, cd AS MATERIALIZED (SELECT ctx, phrase, page_id, prob FROM cx JOIN rs USING (phrase) WHERE rank <= 5), rl AS (SELECT x.ctx, x.phrase, x.page_id, sum(score) AS rel FROM cd x JOIN (SELECT DISTINCT ctx, page_id FROM cd) y USING (ctx) JOIN rel ON rel.a = x.page_id AND rel.b = y.page_id GROUP BY ALL),
sm AS (SELECT cd.*, (coalesce(rel, 0) + 1e-4) / sum(coalesce(rel, 0) + 1e-4) OVER (PARTITION BY ctx, phrase) AS sim FROM cd LEFT JOIN rl USING (ctx, phrase, page_id)), dis AS MATERIALIZED (SELECT ctx, phrase, page_id, prob, sim, (prob + sim) / sum(prob + sim) OVER (PARTITION BY ctx, phrase) AS p FROM sm)"""


@query(f"WITH {BY_SIM} SELECT ctx, phrase, page_id, round(p, 6) AS prob FROM dis")
def disambiguated(spark, d):
    """Senses of the phrases of a context by how related they are to one another, for all contexts at once."""
    return phrases.disambiguate(_contexts(spark, d), _resolved(spark, d, 5), _related(spark, d)).select("ctx", "phrase", "page_id", r("prob"))


@query(f"WITH {BY_SIM} SELECT ctx, phrase, arg_min(page_id, (-round(p, 9), page_id)) AS page_id FROM dis GROUP BY ALL")
def disambiguated_best(spark, d):
    return phrases.disambiguated_top(_contexts(spark, d), _resolved(spark, d, 5), _related(spark, d))


@query(f"""WITH {BY_SIM}, n AS (SELECT *, max(p) OVER (PARTITION BY ctx, phrase) AS most FROM dis) SELECT ctx, phrase, arg_min(page_id, (-round(prob, 9), page_id)) AS page_id FROM n WHERE round(p, 9) >= 0.4 * round(most, 9) GROUP BY ALL""")
def popular_senses(spark, d):
    """Of senses near the best similarity the most popular."""
    s = phrases.disambiguate(_contexts(spark, d), _resolved(spark, d, 5), _related(spark, d)).select("ctx", "phrase", "page_id", F.round("prob", 9).alias("sim"))
    prior = _resolved(spark, d, 5).select("phrase", "page_id", F.round("prob", 9).alias("prob"))
    return phrases.milne_witten_senses(s.join(prior, ["phrase", "page_id"]))


@query(f"""WITH {RES}, {RELATED}, pr AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS phrase1, lower(split_part(p_type, ' ', 1)) AS phrase2 FROM part), j AS (SELECT phrase1, phrase2, x.prob * y.prob AS pop, CASE WHEN x.page_id = y.page_id THEN 1 ELSE coalesce(score, 0) END AS score FROM pr JOIN rs x ON x.phrase = phrase1 AND x.rank <= 100 JOIN rs y ON y.phrase = phrase2 AND y.rank <= 100 LEFT JOIN rel ON rel.a = x.page_id AND rel.b = y.page_id),
n AS (SELECT *, max(score) OVER (PARTITION BY phrase1, phrase2) AS most FROM j), b AS (SELECT phrase1, phrase2, arg_max(score, (round(pop, 12), score)) AS score FROM n WHERE score >= 0.4 * most GROUP BY ALL), k AS (SELECT lower(p_name) AS phrase, count(*) AS n FROM part GROUP BY ALL)
SELECT phrase1, phrase2, round(b.score + CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) > 0 THEN ln(coalesce(x.n, 0) + coalesce(y.n, 0) + 1) / 10 ELSE 0 END, 6) AS score FROM b LEFT JOIN k x ON x.phrase = phrase1 || ' ' || phrase2 LEFT JOIN k y ON y.phrase = phrase2 || ' ' || phrase1""")
def phrase_similarity(spark, d):
    """Relatedness of phrases by their most popular near-best pair of senses."""
    t = table(spark, d, "part")
    pairs = t.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("phrase1"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("phrase2"))
    counts = t.groupBy(F.lower("p_name").alias("phrase")).agg(F.count("*").alias("n"))
    return phrases.pair_similarity(pairs, _resolved(spark, d, 100), _related(spark, d), counts).select("phrase1", "phrase2", r("score"))


@query(f"""WITH {INDEX}, {B.PAGES}, ti AS (SELECT doc_id, term, count(*) * 2 AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(source, '')), '{B.TOKEN}')) AS term FROM documents) GROUP BY ALL)
SELECT 'text' AS field, doc_id, term, tf FROM ix UNION ALL SELECT 'title', doc_id, term, tf FROM ti""")
def field_index(spark, d):
    """An index of several fields, the title counting twice."""
    docs = B.docs(spark, d).select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    return phrases.fields_index(docs, {"text": ("text", 1), "title": ("source", 2)})


def _search_sql(ix: str, q: str, out: str, most: int) -> str:
    return f"""{out}d AS (SELECT term, count(*) AS df FROM {ix} GROUP BY ALL), {out}z AS (SELECT doc_id, sum(tf)::DOUBLE AS size FROM {ix} GROUP BY ALL),
{out}s AS (SELECT phrase, doc_id, sum(sqrt(tf::DOUBLE) * (1 + ln(n / (df + 1))) ^ 2 / sqrt(size)) AS score FROM {q} JOIN {out}d USING (term) JOIN {ix} USING (term) JOIN {out}z USING (doc_id) CROSS JOIN np GROUP BY ALL),
{out}k AS (SELECT * FROM {out}s QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY round(score, 9) DESC, doc_id) <= {most}), {out} AS MATERIALIZED (SELECT phrase, doc_id AS page_id, score / sum(score) OVER (PARTITION BY phrase) AS prob FROM {out}k)"""


@query(f"""WITH np AS (SELECT count(*)::DOUBLE AS n FROM part), it AS MATERIALIZED (SELECT p_partkey AS doc_id, term, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '{B.TOKEN}')) AS term FROM part) GROUP BY ALL),
ic AS MATERIALIZED (SELECT p_partkey AS doc_id, term, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '{B.TOKEN}')) AS term FROM part) GROUP BY ALL),
ph AS MATERIALIZED (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_type, ' ', 1) ELSE 'X' || split_part(p_type, ' ', 1) END AS phrase FROM part), qw AS MATERIALIZED (SELECT DISTINCT phrase, unnest(regexp_extract_all(lower(phrase), '{B.TOKEN}')) AS term FROM ph),
qp AS MATERIALIZED (SELECT DISTINCT phrase, term FROM (SELECT phrase, substr(lower(phrase), 1, i) AS term FROM (SELECT phrase, unnest(range(3, length(phrase))) AS i FROM ph WHERE length(phrase) > 3 AND NOT contains(phrase, ' ')) UNION ALL SELECT phrase, substr(lower(phrase), i + 1) FROM (SELECT phrase, unnest(range(1, length(phrase) - 2)) AS i FROM ph WHERE length(phrase) > 3 AND NOT contains(phrase, ' ')))),
{_search_sql('it', 'qw', 'r1', 15)}, {_search_sql('ic', 'qw', 'r2', 15)}, {_search_sql('ic', 'qp', 'r3', 10)},
u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 WHERE phrase NOT IN (SELECT phrase FROM r1) UNION ALL SELECT * FROM r3 WHERE phrase NOT IN (SELECT phrase FROM r1 UNION SELECT phrase FROM r2))
SELECT phrase, page_id, round(prob, 6) AS prob FROM u QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY round(prob, 9) DESC, page_id) <= 5""")
def searched_senses(spark, d):
    """Pages for phrases by title, else by text, else by parts of the word."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    asked = p.select(F.when(k == 0, first("p_name")).when(k == 1, first("p_type")).otherwise(F.concat(F.lit("X"), first("p_type"))).alias("phrase")).distinct()
    index = phrases.fields_index(p, {"title": ("p_name", 1), "text": ("p_type", 1)}, "p_partkey")
    return phrases.text_senses(asked, index, p.count(), 5).select("phrase", "page_id", r("prob"))


@query("""WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w, p_name || ' and ' || p_name AS text FROM part), l AS (SELECT doc_id, text, w[1] AS anchor, 1 AS k, length(w[1]) AS n, 0 AS at FROM w UNION ALL SELECT doc_id, text, w[len(w)], 2, length(w[len(w)]), 0 FROM w)
SELECT a.doc_id, a.doc_id * 10 + 1 AS page_id, a.anchor, (strpos(a.text, a.anchor) - 1)::INTEGER AS begin, (strpos(a.text, a.anchor) - 1 + a.n)::INTEGER AS "end" FROM l a WHERE k = 1
UNION ALL SELECT b.doc_id, b.doc_id * 10 + 2, b.anchor, (a.n + strpos(substr(b.text, a.n + 1), b.anchor) - 1)::INTEGER, (a.n + strpos(substr(b.text, a.n + 1), b.anchor) - 1 + b.n)::INTEGER FROM l b JOIN l a ON a.doc_id = b.doc_id AND a.k = 1 WHERE b.k = 2""")
def own_links(spark, d):
    """A text's own links, aligned to it by their anchors in order."""
    t = table(spark, d, "part").withColumn("w", F.split("p_name", " "))
    docs = t.select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" and "), "p_name").alias("text"))
    rows = lambda k, w: t.select(F.col("p_partkey").alias("doc_id"), F.lit(k).alias("location"), w.alias("anchor"), (F.col("p_partkey") * 10 + k).alias("page_id"))
    return wikify.identity(docs, rows(1, F.element_at("w", 1)).unionByName(rows(2, F.element_at("w", -1))))


@query(f"""WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part) SELECT doc_id, 'en:' || w[1] || ' /w/en/' || doc_id::VARCHAR || '/x /c/' || (doc_id // 4)::VARCHAR || CASE WHEN len(w) > 1 THEN ' ' || array_to_string(list_transform(w[2:], lambda x: 'en:' || x), ' ') ELSE '' END AS line FROM w""")
def concept_corpus(spark, d):
    """Corpus lines for several languages: words with their language, mentions with page and concept."""
    p = table(spark, d, "part")
    url = F.concat(F.lit("/w/en/"), F.col("p_partkey").cast("string"), F.lit("/x"))
    lines = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(":"), url, F.when(F.contains("p_name", F.lit(" ")), F.expr("substr(p_name, instr(p_name, ' '))")).otherwise("")).alias("line"))
    return wikify.universal_corpus(lines, p.select(url.alias("url"), F.floor(F.col("p_partkey") / 4).alias("univ_id")), "en")


@query("""SELECT p_partkey AS page_id, regexp_replace(p_name, '^(.)(.*)$', '\\1') AS first, CASE WHEN length(p_name) > 3 AND NOT contains(p_name, ' ') THEN 2 * (length(p_name) - 3) ELSE 0 END::INTEGER AS n FROM part""")
def word_parts(spark, d):
    """Heads and tails of words for a search by parts."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.substring("p_name", 1, 1).alias("first"), F.size(phrases.split_variants(F.col("p_name"))).alias("n"))


@query("SELECT doc_id, md5(trim(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g')))) AS normal, md5(lower(trim(coalesce(text, ''), ' '))) AS folded FROM documents")
def string_forms(spark, d):
    """Whole texts by their string normalizers, as digests."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(t)).alias("normal"), F.md5(T.fold_case(t)).alias("folded"))


# shapes -------------------------------------------------------------------------------------------------------------------

GRID = "bx AS MATERIALIZED (SELECT i::INTEGER AS region_id, (i % 12)::INTEGER AS cx, (i // 12)::INTEGER AS cy FROM range(96) t(i))"


@query(f"WITH {GRID} SELECT region_id, round(cx * 30.0::DOUBLE - 165, 6) AS lon, round(cy * 20.0::DOUBLE - 70, 6) AS lat FROM bx")
def region_centres(spark, d):
    return spatial.centre(_boxes(spark)).select("region_id", r("lon"), r("lat"))


@query(f"WITH {B.POINTS} SELECT id, round(cos(radians(lat)) * sin(radians(-lon)), 9) AS x, round(cos(radians(lat)) * cos(radians(-lon)), 9) AS y, round(sin(radians(-lat)), 9) AS z FROM points")
def unit_vectors(spark, d):
    p = B.points(spark, d).withColumn("v", spatial.unit_vector(F.col("lon"), F.col("lat")))
    return p.select("id", *[F.round(F.get("v", F.lit(i)), 9).alias(c) for i, c in enumerate("xyz")])


@query(f"""WITH {B.POINTS}, m AS MATERIALIZED (SELECT x.id AS a, y.id AS b, round({_M}, 3) AS m FROM points x JOIN points y ON x.id <> y.id), k AS (SELECT a, m FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY m, b) <= 50), e AS (SELECT a, count(*) AS n, max(m) AS edge FROM k GROUP BY ALL),
c AS (SELECT m.a, m.b, count(*) AS o FROM m JOIN e USING (a) JOIN k ON k.a = m.a AND k.m < m.m WHERE m.m < edge GROUP BY ALL)
SELECT m.a, m.b, round(CASE WHEN m.m < edge THEN coalesce(o, 0) ELSE e.n + (m.m - edge) / (40075017.0::DOUBLE / 2 - edge) * ((SELECT count(*) FROM points) - e.n) END, 4) AS ordinal FROM m JOIN e USING (a) LEFT JOIN c ON c.a = m.a AND c.b = m.b""")
def estimated_ordinals(spark, d):
    """Ordinal distances of all pairs of places, estimated from the nearest fifty."""
    p = B.points(spark, d)
    near = spatial.nearest(p, p, 50).select("a", F.round("metres", 3).alias("metres"))
    return spatial.all_ordinals(p, near, p.count()).select("a", "b", r("ordinal", 4))


@query(f"WITH {GRID} SELECT x.region_id AS owner, y.region_id AS node, greatest(abs(x.cx - y.cx), abs(x.cy - y.cy))::INTEGER AS hops FROM bx x CROSS JOIN bx y WHERE x.region_id % 20 = 0")
def border_hops(spark, d):
    """How many borders lie between regions."""
    b = _boxes(spark).where("ring = 0")
    starts = b.where("region_id % 20 = 0").select(F.col("region_id").alias("owner"), F.col("region_id").alias("node"))
    return spatial.region_hops(starts, spatial.bordering(b))


@query(f"WITH {GRID} SELECT x.region_id, y.region_id AS other FROM bx x JOIN bx y ON x.region_id <> y.region_id AND abs(x.cx - y.cx) <= 1 AND abs(x.cy - y.cy) <= 1 WHERE x.region_id % 20 = 0 AND y.region_id % 3 > 0")
def touching_regions(spark, d):
    b = _boxes(spark).where("ring = 0")
    return spatial.touching(b, b.where("region_id % 20 = 0"), b.where("region_id % 3 = 0"))


@query(f"""WITH {GRID} SELECT (1000 + n_nationkey)::INTEGER AS a, region_id AS b FROM nation JOIN bx ON cx * 30 - 180 <= n_nationkey * 12 - 150 + 5 AND cx * 30 - 150 >= n_nationkey * 12 - 150 AND cy * 20 - 80 <= n_nationkey * 5 - 60 + 3 AND cy * 20 - 60 >= n_nationkey * 5 - 60""")
def intersecting_regions(spark, d):
    """Small boxes and the regions that they share a point with."""
    x, y = F.col("n_nationkey") * 12.0 - 150, F.col("n_nationkey") * 5.0 - 60
    path = F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in ((0, 0), (5, 0), (5, 3), (0, 3))])
    small = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("int").alias("region_id"), F.lit(0).alias("ring"), path.alias("path"))
    return spatial.intersecting(small, _boxes(spark).where("ring = 0"))


@query("""SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'country' ELSE 'wikidata' END AS layer FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 0 AND p_size < 10""")
def shape_lookups(spark, d):
    """Shapes by layer, reference system, precision and title."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    shapes = p.select(k.alias("item_id"), F.when(k % 3 == 0, "country").otherwise("wikidata").alias("layer"), F.lit("earth").alias("ref_sys"), F.when(k % 2 == 0, "HIGH").otherwise("LOW").alias("precision"))
    titles = p.where("p_size < 10").select(F.col("p_name").alias("title"), k.alias("item_id"))
    return spatial.geometries(shapes, layer="wikidata", ref_sys="earth", precision="HIGH", titles=titles).select("item_id", "layer")


PLACES = f"""{RES}, nm AS (SELECT p_partkey AS key, 0 AS i, lower(split_part(p_name, ' ', 1)) AS phrase FROM part UNION ALL SELECT p_partkey, 1, lower(split_part(p_type, ' ', 1)) FROM part), bs AS (SELECT key, page_id AS univ_id, 0.7::DOUBLE ^ i * prob AS score FROM nm JOIN rs USING (phrase) WHERE rank <= 10),
ev AS (SELECT key, univ_id, score FROM bs UNION ALL SELECT b.key, b.univ_id, 0.25 FROM (SELECT DISTINCT key, univ_id FROM bs) b WHERE univ_id % 2 = 0), sc AS (SELECT key, univ_id, round(sum(score), 9) AS score FROM ev GROUP BY ALL), pl AS MATERIALIZED (SELECT key, univ_id, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, univ_id) AS rank FROM sc)"""


def _places(spark, d):
    p, first = table(spark, d, "part"), lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))
    names = p.select(F.col("p_partkey").alias("key"), F.lit(0).alias("i"), first("p_name").alias("phrase")).unionByName(p.select(F.col("p_partkey").alias("key"), F.lit(1).alias("i"), first("p_type").alias("phrase")))
    senses = _resolved(spark, d).select("phrase", F.col("page_id").alias("univ_id"), "prob")
    even = names.join(senses, "phrase").where("univ_id % 2 = 0").select("key", "univ_id", F.lit(0.25).alias("score")).distinct()
    got = spatial.resolve_places(names, senses, [even], 1000)
    return links.top(got.select("key", "univ_id", F.round("score", 9).alias("score")), 3, [F.desc("score"), F.asc("univ_id")], ["key"])


@query(f"WITH {PLACES} SELECT key, rank::INTEGER AS rank, univ_id, round(score, 6) AS score FROM pl WHERE rank <= 3")
def resolved_places(spark, d):
    """Which concept each row of a gazetteer means."""
    return _places(spark, d).select("key", "rank", "univ_id", r("score"))


@query(f"""WITH {PLACES}, o AS (SELECT p_partkey AS key, p_size::BIGINT AS univ_id, CASE WHEN p_partkey % 2 = 0 THEN 'V' ELSE 'U' END AS status FROM part WHERE p_partkey % 5 > 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN status = 'V' THEN o.univ_id ELSE coalesce(n.univ_id, o.univ_id) END AS univ_id, CASE WHEN status = 'V' THEN 'V' ELSE 'U' END AS status FROM o FULL JOIN (SELECT key, univ_id FROM pl WHERE rank = 1) n ON n.key = o.key""")
def merged_places(spark, d):
    """Verified matches stay, others take the new guess."""
    k = F.col("p_partkey")
    old = table(spark, d, "part").where("p_partkey % 5 > 0").select(k.alias("key"), F.col("p_size").cast("long").alias("univ_id"), F.when(k % 2 == 0, "V").otherwise("U").alias("status"))
    return spatial.merge_matches(old, _places(spark, d))


@query(f"""WITH {B.POINTS}, {DIRECT}, m AS (SELECT x.id AS a, y.id AS b, {_M} AS m FROM points x JOIN points y ON x.id <> y.id WHERE {_M} <= 2000000)
SELECT floor(round(m, 3) / 250000)::BIGINT AS level, count(*) AS pairs, round(avg(score), 6) AS mean_score FROM m JOIN dl USING (a, b) GROUP BY ALL""")
def relatedness_by_distance(spark, d):
    """Whether near places are more related: of all pairs of places that have a score."""
    scores = _direct(spark, d)
    w = spatial.between(scores.where("a <> b"), B.points(spark, d), 2_000_000.0).withColumn("metres", F.round("metres", 3))
    return spatial.scored_levels(w, 250_000.0).select("level", "pairs", r("mean_score"))


# scans, lookups and metrics -------------------------------------------------------------------------------------------------


@query("SELECT (p_partkey % 4 + 1)::INTEGER AS lang_id, p_size::BIGINT AS category_id, p_partkey AS article_id FROM part WHERE p_partkey % 4 + 1 IN (2, 3)")
def category_scan(spark, d):
    m = B.members(spark, d).withColumn("lang_id", (F.col("article_id") % 4 + 1).cast("int"))
    return filters.LanguageFilter([2, 3]).apply(m).select("lang_id", "category_id", "article_id")


@query(f"WITH {B.REDIRECTS} SELECT (src_page_id % 4 + 1)::INTEGER AS lang_id, src_page_id, dest_page_id FROM redirects WHERE src_page_id % 4 + 1 = 1")
def redirect_scan(spark, d):
    m = B.redirects(spark, d).withColumn("lang_id", (F.col("src_page_id") % 4 + 1).cast("int"))
    return filters.LanguageFilter([1]).apply(m).select("lang_id", "src_page_id", "dest_page_id")


@query(f"WITH {B.PAGES}, {B.REDIRECTS} SELECT page_id, page_id IN (SELECT src_page_id FROM redirects) AS redirects FROM pages")
def redirect_predicate(spark, d):
    return filters.redirect_flags(B.pages(spark, d), B.redirects(spark, d))


@query(f"""WITH {B.LINKS}, a AS (SELECT DISTINCT lang_id, source_id, dest_id FROM links WHERE source_id % 20 = 0 UNION SELECT DISTINCT lang_id, source_id, dest_id + 1000000 FROM links WHERE source_id % 20 = 0), f AS (SELECT lang_id, source_id, dest_id, arg_min(anchor_text, (location, anchor_text)) AS anchor_text, min(location) AS location FROM links GROUP BY ALL)
SELECT a.lang_id, a.source_id, a.dest_id, anchor_text, location FROM a LEFT JOIN f USING (lang_id, source_id, dest_id)""")
def single_links(spark, d):
    """The first link between two pages, also asked for where there is none."""
    x = B.links(spark, d).select("lang_id", "source_id", "dest_id", "location", "anchor_text")
    some = x.where("source_id % 20 = 0")
    asked = some.select("lang_id", "source_id", "dest_id").union(some.select("lang_id", "source_id", F.col("dest_id") + 1_000_000))
    return links.single_edges(asked, x).select("lang_id", "source_id", "dest_id", "anchor_text", "location")


@query(f"""WITH {B.PAGES}, {ILLS}, o AS (SELECT source_lang AS lang_id, source_id AS page_id, count(DISTINCT (dest_lang, dest_id)) AS n, min((dest_lang, dest_id)) AS f FROM ills GROUP BY ALL), i AS (SELECT dest_lang AS lang_id, dest_id AS page_id, count(DISTINCT (source_lang, source_id)) AS n FROM ills GROUP BY ALL)
SELECT p.lang_id, p.page_id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in FROM pages p LEFT JOIN o USING (lang_id, page_id) LEFT JOIN i USING (lang_id, page_id)""")
def linked_languages(spark, d):
    """What each page links to in other languages, and what links to it."""
    ills, p = _ills(spark, d), B.pages(spark, d)
    out = links.languages_of(ills, p).select("lang_id", "page_id", F.size("others").cast("long").alias("n_out"))
    return out.join(links.languages_of(ills, p, outward=False).select("lang_id", "page_id", F.size("others").cast("long").alias("n_in")), ["lang_id", "page_id"])


@query(f"WITH {B.PAGES}, c AS (SELECT (p_partkey % 4 + 1)::INTEGER AS lang_id, p_partkey AS article_id, p_brand || ' ' || (p_size * 10)::VARCHAR AS category FROM part) SELECT c.lang_id, article_id, category, coalesce(page_id, -1) AS category_id FROM c LEFT JOIN pages p ON p.lang_id = c.lang_id AND p.title = category AND p.name_space = 14")
def category_pages_by_title(spark, d):
    """Category links by title, matched with pages of the category namespace only."""
    c = table(spark, d, "part").select((F.col("p_partkey") % 4 + 1).cast("int").alias("lang_id"), F.col("p_partkey").alias("article_id"), F.concat("p_brand", F.lit(" "), (F.col("p_size") * 10).cast("string")).alias("category"))
    return links.category_targets(c, B.pages(spark, d)).select("lang_id", "article_id", "category", "category_id")


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT id AS a, id + 3 AS b FROM v WHERE id % 2 = 0)
SELECT p.a, p.b, round(CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN coalesce(list_cosine_similarity(x.v, y.v), 0) END, 6) AS score FROM p LEFT JOIN v x ON x.id = a LEFT JOIN v y ON y.id = b""")
def dense_metric_pairs(spark, d):
    v = _vectors(spark, d)
    return knn.DenseMetric(v).similarity(v.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))).select("a", "b", r("score"))


@query(f"""WITH {DENSE}, m AS (SELECT q.id AS a, c.id AS b, list_cosine_similarity(q.v, c.v) AS s, 1.0::DOUBLE / (1 + abs(q.id - c.id)) AS t FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
x AS (SELECT a, b FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 500 UNION SELECT a, b FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY t DESC, b) <= 500), w AS (SELECT a, b, (3 * s + t) / 4 AS score FROM m SEMI JOIN x USING (a, b))
SELECT a, row_number() OVER o::INTEGER AS rank, b, round(score, 6) AS score FROM w WINDOW o AS (PARTITION BY a ORDER BY round(score, 9) DESC, b) QUALIFY row_number() OVER o <= 10""")
def ensemble_neighbours(spark, d):
    """Two metrics as one: candidates of each, scored by both."""
    v = _vectors(spark, d)

    class Near:
        """Ids that are near in number."""

        def similarity(self, pairs):
            return pairs.select("a", "b", (F.lit(1.0) / (1 + F.abs(F.col("a") - F.col("b")))).alias("score"))

        def most_similar(self, ids, k):
            # stated queries and ids alone
            pairs = ids.select(F.col("id").alias("a")).join(knn.unit(v).select(F.col("id").alias("b")), F.col("a") != F.col("b"))
            return similarity.most_similar(self.similarity(pairs), k)

    parts = {"vectors": knn.DenseMetric(v), "near": Near()}
    return ensemble.EnsembleMetric(parts, {"vectors": 3.0, "near": 1.0}).most_similar(knn.unit(v).where("id % 20 = 0").select("id"), 10).select("a", "rank", "b", r("score"))


@query(f"""WITH {RES}, {B.EDGES}, pv AS (SELECT dest_id AS row_id, source_id AS col_id, 1.0::DOUBLE AS value FROM e WHERE dest_id < 60), g AS (SELECT phrase, page_id AS col_id, 2.0::DOUBLE AS value FROM rs WHERE rank <= 2 AND page_id % 2 = 0), k AS (SELECT phrase, page_id AS col_id, 3.0::DOUBLE AS value FROM rs WHERE rank <= 3 AND page_id % 3 = 0),
b AS (SELECT phrase, col_id, value FROM rs JOIN pv ON row_id = page_id WHERE rank = 1), gk AS (SELECT * FROM g UNION ALL SELECT * FROM k WHERE phrase NOT IN (SELECT phrase FROM g))
SELECT 'both' AS mode, phrase, col_id, value FROM (SELECT * FROM gk UNION ALL SELECT * FROM b WHERE phrase NOT IN (SELECT phrase FROM gk)) UNION ALL SELECT 'generator', phrase, col_id, value FROM (SELECT * FROM g UNION ALL SELECT * FROM b WHERE phrase NOT IN (SELECT phrase FROM g)) UNION ALL SELECT 'none', phrase, col_id, value FROM b""")
def phrase_vectors_by_mode(spark, d):
    """Phrases' vectors from a generator, from candidates or from the page they most likely mean."""
    s = _resolved(spark, d)
    pages = B.edges(spark, d).where("dest_id < 60").select(F.col("dest_id").alias("row_id"), F.col("source_id").alias("col_id"), F.lit(1.0).alias("value"))
    g = s.where("rank <= 2 and page_id % 2 = 0").select(F.col("phrase").alias("row_id"), F.col("page_id").alias("col_id"), F.lit(2.0).alias("value"))
    k = s.where("rank <= 3 and page_id % 3 = 0").select(F.col("phrase").alias("row_id"), F.col("page_id").alias("col_id"), F.lit(3.0).alias("value"))
    out = None
    for mode in ("both", "generator", "none"):
        part = esa.phrase_vectors_by(mode, s.select("phrase"), g, k, s, pages).select(F.lit(mode).alias("mode"), "phrase", "col_id", "value")
        out = part if out is None else out.unionByName(part)
    return out
