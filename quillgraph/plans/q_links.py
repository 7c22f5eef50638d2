"""Queries over links, redirects, concepts and page views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, filters, graph, links, pageviews, similarity
from ..session import table
from . import bind as B
from .bind import r
from .catalogue import query

INLINK = f"""{B.EDGES}, deg AS MATERIALIZED (SELECT dest_id AS id, count(*) AS n FROM e GROUP BY ALL), npages AS (SELECT count(*)::DOUBLE AS n FROM deg),
pairs AS MATERIALIZED (SELECT x.dest_id AS a, y.dest_id AS b, count(*) AS ab FROM e x JOIN e y ON x.source_id = y.source_id AND x.dest_id <> y.dest_id GROUP BY ALL),
ins AS MATERIALIZED (SELECT a, b, 1 - (ln(greatest(p.n, q.n)::DOUBLE) - ln(ab::DOUBLE)) / (ln(npages.n) - ln(least(p.n, q.n)::DOUBLE)) AS score FROM pairs JOIN deg p ON p.id = a JOIN deg q ON q.id = b CROSS JOIN npages)"""
TOP = "SELECT a, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b)::INTEGER AS rank, b, round(score, 6) AS score FROM {0} QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) <= {1}"


def _linked(spark, d):
    e = B.edges(spark, d)
    return e, e.select("dest_id").distinct().count()


def _inlink(spark, d):
    return similarity.inlink(*_linked(spark, d))


@query(f"WITH {INLINK} {TOP.format('ins', 10)}")
def inlink_most_similar(spark, d):
    """The ten articles nearest to each by shared in-links."""
    return similarity.inlink_most_similar(*_linked(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {INLINK} SELECT a, b, round(score, 6) AS score FROM ins")
def inlink_similarity(spark, d):
    return _inlink(spark, d).select("a", "b", r("score"))


OUTLINK = f"""{B.EDGES}, odeg AS (SELECT dest_id, count(*) AS n FROM e GROUP BY ALL), nsrc AS (SELECT count(DISTINCT source_id)::DOUBLE AS n FROM e),
w AS MATERIALIZED (SELECT source_id, e.dest_id, ln(nsrc.n / odeg.n) AS v FROM e JOIN odeg USING (dest_id) CROSS JOIN nsrc WHERE ln(nsrc.n / odeg.n) > 0),
nrm AS MATERIALIZED (SELECT source_id, sqrt(sum(v * v)) AS n FROM w GROUP BY ALL),
outs AS MATERIALIZED (SELECT x.source_id AS a, y.source_id AS b, sum(x.v * y.v) / (any_value(p.n) * any_value(q.n)) AS score FROM w x JOIN w y ON x.dest_id = y.dest_id AND x.source_id <> y.source_id
  JOIN nrm p ON p.source_id = x.source_id JOIN nrm q ON q.source_id = y.source_id GROUP BY ALL)"""


@query(f"WITH {OUTLINK} {TOP.format('outs', 5)}")
def outlink_most_similar(spark, d):
    """The five sources nearest to each by out-links, rare targets weighing more."""
    return similarity.outlink_most_similar(B.edges(spark, d), 5).withColumn("score", F.round("score", 6))


CUST = "ce AS MATERIALIZED (SELECT DISTINCT o_custkey AS source_id, l_suppkey AS dest_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def customer_graph(spark, d):
    """Pages that both link and are linked: customers and suppliers share a space of ids."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("source_id"), F.col("l_suppkey").alias("dest_id")).distinct()


MW = f"""{CUST}, ideg AS (SELECT dest_id AS id, count(*) AS n FROM ce GROUP BY ALL), np AS (SELECT count(*)::DOUBLE + 1000 AS n FROM ideg),
ip AS MATERIALIZED (SELECT x.dest_id AS a, y.dest_id AS b, count(*) AS ab FROM ce x JOIN ce y ON x.source_id = y.source_id AND x.dest_id <> y.dest_id GROUP BY ALL),
ci AS MATERIALIZED (SELECT a, b, 1 - (ln(greatest(p.n, q.n)::DOUBLE) - ln(ab::DOUBLE)) / (ln(np.n) - ln(least(p.n, q.n)::DOUBLE)) AS score FROM ip JOIN ideg p ON p.id = a JOIN ideg q ON q.id = b CROSS JOIN np),
od AS (SELECT dest_id, count(*) AS n FROM ce GROUP BY ALL), ns AS (SELECT count(DISTINCT source_id)::DOUBLE AS n FROM ce),
cw AS MATERIALIZED (SELECT source_id, ce.dest_id, ln(ns.n / od.n) AS v FROM ce JOIN od USING (dest_id) CROSS JOIN ns WHERE ln(ns.n / od.n) > 0),
cn AS MATERIALIZED (SELECT source_id, sqrt(sum(v * v)) AS n FROM cw GROUP BY ALL),
co AS MATERIALIZED (SELECT x.source_id AS a, y.source_id AS b, sum(x.v * y.v) / (any_value(p.n) * any_value(q.n)) AS score FROM cw x JOIN cw y ON x.dest_id = y.dest_id AND x.source_id <> y.source_id
  JOIN cn p ON p.source_id = x.source_id JOIN cn q ON q.source_id = y.source_id GROUP BY ALL)"""


def _customer_links(spark, d):
    e = graph.cut(customer_graph(spark, d))
    return e, e.select("dest_id").distinct().count() + 1000


@query(f"WITH {MW} SELECT coalesce(ci.a, co.a) AS a, coalesce(ci.b, co.b) AS b, round(0.5 * ci.score + 0.5 * co.score, 6) AS score FROM ci FULL JOIN co ON ci.a = co.a AND ci.b = co.b")
def milne_witten_similarity(spark, d):
    return similarity.milne_witten_pairs(*_customer_links(spark, d)).select("a", "b", r("score"))


@query(f"""WITH {MW}, i2 AS (SELECT * FROM ci QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) <= 10), o2 AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) <= 10),
m AS (SELECT coalesce(i2.a, o2.a) AS a, coalesce(i2.b, o2.b) AS b, 0.5 * coalesce(i2.score, 0) + 0.5 * coalesce(o2.score, 0) AS score FROM i2 FULL JOIN o2 ON i2.a = o2.a AND i2.b = o2.b) {TOP.format('m', 5)}""")
def milne_witten_most_similar(spark, d):
    e, n = _customer_links(spark, d)
    ins, outs = similarity.inlink_most_similar(e, n, 10), similarity.outlink_most_similar(e, 10)
    return similarity.milne_witten_best(ins, outs, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {CUST} SELECT a, b, count(*) / 2.0::DOUBLE AS score FROM (SELECT source_id AS a, dest_id AS b FROM ce UNION ALL SELECT dest_id, source_id FROM ce) WHERE a <> b GROUP BY ALL")
def direct_link(spark, d):
    return similarity.direct_link(customer_graph(spark, d))


@query(f"""WITH {MW}, both_ways AS (SELECT DISTINCT source_id AS a, dest_id AS b FROM ce UNION SELECT dest_id, source_id FROM ce)
SELECT ip.a, ip.b, round(2000.0::DOUBLE * ab / (p.n * q.n) * log10(ab::DOUBLE) / (CASE WHEN l.a IS NULL THEN 2 ELSE 1 END), 6) AS score
FROM ip JOIN ideg p ON p.id = ip.a JOIN ideg q ON q.id = ip.b LEFT JOIN both_ways l ON l.a = ip.a AND l.b = ip.b AND l.a <> l.b""")
def syn_rank(spark, d):
    e = customer_graph(spark, d)
    return similarity.syn_rank(e, 2000, e).select("a", "b", r("score"))


@query(f"""WITH {B.EDGES}, deg AS (SELECT dest_id, count(*)::DOUBLE AS n FROM e GROUP BY ALL), v AS (SELECT source_id, e.dest_id, 1 / n AS v FROM e JOIN deg USING (dest_id)),
p AS (SELECT x.source_id AS a, y.source_id AS b, x.dest_id AS col_id, x.v * y.v AS product FROM v x JOIN v y ON x.dest_id = y.dest_id AND x.source_id < y.source_id)
SELECT a, b, row_number() OVER w::INTEGER AS rank, col_id, round(product, 9) AS product FROM p WINDOW w AS (PARTITION BY a, b ORDER BY product DESC, col_id) QUALIFY row_number() OVER w <= 2""")
def explanations(spark, d):
    """What two sources share, the rarest first."""
    e = B.edges(spark, d)
    deg = e.groupBy("dest_id").agg(F.count("*").cast("double").alias("n"))
    v = e.join(deg, "dest_id").select(F.col("source_id").alias("row_id"), F.col("dest_id").alias("col_id"), (1 / F.col("n")).alias("value"))
    return similarity.explain(v, 2).select("a", "b", "rank", "col_id", r("product", 9))


@query(f"""WITH {B.EDGES}, f AS (SELECT dest_id, count(*) AS n FROM e GROUP BY ALL) SELECT source_id AS row_id, row_number() OVER w::INTEGER AS rank, e.dest_id AS col_id, 1.0::DOUBLE AS value, f.n AS col_count
FROM e JOIN f USING (dest_id) WINDOW w AS (PARTITION BY source_id ORDER BY e.dest_id) QUALIFY row_number() OVER w <= 3""")
def matrix_summary(spark, d):
    return similarity.row_summary(similarity.link_vectors(B.edges(spark, d)), 3)


@query(f"""WITH {B.EDGES}, deg AS (SELECT dest_id AS page_id, count(*) AS in_degree FROM e GROUP BY ALL), k AS (SELECT floor(2 * round(count(*) ^ (1.0 / 3), 9))::BIGINT AS s, floor(1000 * round(count(*) ^ (1.0 / 3), 9))::BIGINT AS t FROM deg)
SELECT page_id, in_degree FROM deg, k QUALIFY row_number() OVER (ORDER BY in_degree DESC, page_id) BETWEEN s + 1 AND s + t""")
def concept_space(spark, d):
    return similarity.concept_space(B.edges(spark, d))


@query(f"""WITH {B.EDGES} SELECT page_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source_id AS page_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dest_id, 0, 1 FROM e) GROUP BY ALL""")
def degrees(spark, d):
    return links.degrees(B.edges(spark, d))


@query(f"WITH {B.LINKS} SELECT count(DISTINCT (source_id, dest_id)) AS n_links FROM links")
def link_count(spark, d):
    return links.link_count(B.links(spark, d))


@query(f"WITH {B.LINKS} SELECT lang_id, source_id, dest_id, anchor_text, location FROM links WHERE lang_id IN (1, 3) AND location_type IN (0, 1) AND is_parseable AND dest_id <> -1")
def link_scan(spark, d):
    f = filters.LinkFilter(langs=[1, 3], location_types=[0, 1], is_parseable=True, has_dest=True)
    return f.apply(B.links(spark, d)).select("lang_id", "source_id", "dest_id", "anchor_text", "location")


@query(f"WITH {B.LINKS} SELECT source_id, location FROM links WHERE dest_id = -1")
def red_links(spark, d):
    return filters.LinkFilter(has_dest=False).apply(B.links(spark, d)).select("source_id", "location")


@query(f"WITH {B.PAGES} SELECT page_id, title FROM pages WHERE name_space = 0 AND NOT is_redirect AND NOT is_disambig AND lang_id IN (1, 2)")
def page_scan(spark, d):
    return B.pages(spark, d).where(filters.normal_page() & filters.PageFilter(langs=[1, 2]).column()).select("page_id", "title")


@query(f"WITH {B.PAGES} SELECT lang_id, name_space, count(*) AS n FROM pages WHERE NOT is_redirect GROUP BY ALL")
def page_counts(spark, d):
    return filters.PageFilter(is_redirect=False).apply(B.pages(spark, d)).groupBy("lang_id", "name_space").agg(F.count("*").alias("n"))


@query(f"WITH {B.PAGES}, {B.REDIRECTS} SELECT k.id AS page_id, p.title FROM (SELECT DISTINCT (l_partkey + l_suppkey)::BIGINT AS id FROM lineitem) k LEFT JOIN pages p ON p.page_id = k.id")
def multi_get(spark, d):
    """A row for each asked id, also for those that aren't there."""
    keys = table(spark, d, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("page_id")).distinct()
    return links.multi_get(keys, B.pages(spark, d).select("page_id", "title"), ["page_id"])


@query(f"""WITH {B.PAGES}, {B.REDIRECTS} SELECT lang_id, name_space, title, min(coalesce(dest_page_id, page_id)) AS page_id FROM pages LEFT JOIN redirects ON page_id = src_page_id GROUP BY ALL""")
def title_index(spark, d):
    return links.title_index(B.pages(spark, d), B.redirects(spark, d))


@query(f"WITH {B.LINKS}, {B.REDIRECTS} SELECT source_id, coalesce(dest_page_id, dest_id) AS dest_id, count(*) AS n FROM links LEFT JOIN redirects ON dest_id = src_page_id GROUP BY ALL")
def resolve_redirects(spark, d):
    return links.resolve(B.links(spark, d), B.redirects(spark, d)).groupBy("source_id", "dest_id").agg(F.count("*").alias("n"))


@query(f"""WITH {B.REDIRECTS}, h AS (SELECT a.src_page_id, a.dest_page_id AS d1, b.dest_page_id AS d2, c.dest_page_id AS d3, x.dest_page_id AS d4, y.src_page_id AS again FROM redirects a
  LEFT JOIN redirects b ON b.src_page_id = a.dest_page_id LEFT JOIN redirects c ON c.src_page_id = coalesce(b.dest_page_id, a.dest_page_id) LEFT JOIN redirects x ON x.src_page_id = coalesce(c.dest_page_id, b.dest_page_id, a.dest_page_id)
  LEFT JOIN redirects y ON y.src_page_id = coalesce(x.dest_page_id, c.dest_page_id, b.dest_page_id, a.dest_page_id))
SELECT src_page_id, (CASE WHEN again IS NULL THEN coalesce(d4, d3, d2, d1) ELSE -1 END)::BIGINT AS dest_page_id FROM h""")
def redirect_chains(spark, d):
    return links.resolve_chains(B.redirects(spark, d)).withColumn("dest_page_id", F.col("dest_page_id").cast("long"))


@query(f"WITH {B.REDIRECTS} SELECT dest_page_id, count(*) AS n, min(src_page_id) AS first_source FROM redirects GROUP BY ALL")
def redirects_to(spark, d):
    return links.redirects_to(B.redirects(spark, d), gather=False).groupBy("dest_page_id").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


@query(f"""WITH {B.PAGES}, {B.REDIRECTS} SELECT p.page_id AS asked_id, CASE WHEN p.is_redirect AND t.page_id IS NOT NULL THEN t.page_id ELSE p.page_id END AS page_id, CASE WHEN p.is_redirect AND t.page_id IS NOT NULL THEN t.title ELSE p.title END AS title
FROM pages p LEFT JOIN redirects r ON r.src_page_id = p.page_id LEFT JOIN pages t ON t.page_id = r.dest_page_id AND NOT t.is_disambig""")
def follow_redirects(spark, d):
    return links.follow_pages(B.pages(spark, d), B.redirects(spark, d), ~F.col("is_disambig")).select("asked_id", "page_id", "title")


@query(f"""WITH {B.LINKS}, {B.PAGES} SELECT source_id, t.title AS dest_title, coalesce(p.page_id, -1) AS dest_id, count(*) AS n FROM (SELECT source_id, 'Brand#11 ' || dest_id::VARCHAR AS title FROM links) t LEFT JOIN pages p ON p.title = t.title GROUP BY ALL""")
def link_targets(spark, d):
    """Links by title to pages; red links have no page."""
    t = B.links(spark, d).select("source_id", F.concat(F.lit("Brand#11 "), F.col("dest_id").cast("string")).alias("dest_title"))
    return links.link_targets(t, B.pages(spark, d)).groupBy("source_id", "dest_title", "dest_id").agg(F.count("*").alias("n"))


@query(f"WITH {B.LINKS}, {B.EDGES} SELECT DISTINCT source_id, dest_id FROM e ANTI JOIN (SELECT * FROM links WHERE is_parseable) k USING (source_id, dest_id)")
def missing_links(spark, d):
    return links.missing_links(B.edges(spark, d), B.links(spark, d).where("is_parseable")).distinct()


UNIVERSAL = f"""{B.LINKS}, {B.CONCEPTS}, uni AS MATERIALIZED (SELECT l.lang_id, coalesce(s.univ_id, -1) AS univ_source_id, coalesce(t.univ_id, -1) AS univ_dest_id FROM links l
LEFT JOIN concepts s ON s.lang_id = l.lang_id AND s.page_id = l.source_id LEFT JOIN concepts t ON t.lang_id = l.lang_id AND t.page_id = l.dest_id)"""


@query(f"WITH {UNIVERSAL} SELECT lang_id, univ_source_id, univ_dest_id, count(*) AS n FROM uni GROUP BY ALL")
def universal_links(spark, d):
    return links.universal_links(B.links(spark, d), B.concepts(spark, d)).groupBy("lang_id", "univ_source_id", "univ_dest_id").agg(F.count("*").alias("n"))


@query(f"WITH {UNIVERSAL} SELECT univ_source_id, univ_dest_id, list_sort(list(DISTINCT lang_id))::VARCHAR AS langs FROM uni WHERE univ_source_id <> -1 AND univ_dest_id <> -1 GROUP BY ALL")
def skeletal_links(spark, d):
    s = links.skeletal_links(links.universal_links(B.links(spark, d), B.concepts(spark, d)))
    return s.withColumn("langs", F.concat(F.lit("["), F.array_join(F.col("langs").cast("array<string>"), ", "), F.lit("]")))


@query(f"WITH {UNIVERSAL} SELECT univ_dest_id AS univ_id, count(DISTINCT univ_source_id) AS n, count(DISTINCT lang_id) AS langs FROM uni WHERE univ_source_id <> -1 AND univ_dest_id <> -1 GROUP BY ALL")
def universal_inlinks(spark, d):
    s = links.skeletal_links(links.universal_links(B.links(spark, d), B.concepts(spark, d)))
    e = links.universal_neighbours(s, out=False, gather=False).select("univ_id", "other", F.explode("langs").alias("lang"))
    return e.groupBy("univ_id").agg(F.countDistinct("other").alias("n"), F.countDistinct("lang").alias("langs"))


@query(f"WITH {B.CONCEPTS} SELECT univ_id, array_to_string(list_sort(list(lang_id::VARCHAR || ':' || page_id::VARCHAR)), ', ') AS pages FROM concepts GROUP BY ALL")
def concept_pages(spark, d):
    c = links.concept_pages(B.concepts(spark, d))
    return c.select("univ_id", F.array_join(F.array_sort(F.transform("pages", lambda p: F.concat(p["lang_id"].cast("string"), F.lit(":"), p["page_id"].cast("string")))), ", ").alias("pages"))


@query(f"WITH {B.CONCEPTS} SELECT univ_id, count(DISTINCT lang_id)::DOUBLE / count(*) AS clarity FROM concepts GROUP BY ALL")
def concept_clarity(spark, d):
    return filters.clarity(B.concepts(spark, d))


@query(f"""WITH {B.CONCEPTS}, t AS (SELECT univ_id, min(page_id) AS to_page_id FROM concepts WHERE lang_id = 2 GROUP BY ALL) SELECT c.lang_id, c.page_id, univ_id, to_page_id FROM concepts c JOIN t USING (univ_id)""")
def translate_concepts(spark, d):
    from ..operators import concepts

    c = B.concepts(spark, d)
    return concepts.translate(c.select("lang_id", "page_id"), c, 2).select("lang_id", "page_id", "univ_id", "to_page_id")


@query(f"""WITH {B.LINKS}, o AS (SELECT DISTINCT source_id, dest_id FROM links WHERE lang_id <= 2), n AS (SELECT DISTINCT source_id, dest_id FROM links WHERE lang_id >= 2)
SELECT coalesce(o.source_id, n.source_id) AS page_id, count(*) FILTER (o.source_id IS NULL) AS added, count(*) FILTER (n.source_id IS NULL) AS removed FROM o FULL JOIN n ON o.source_id = n.source_id AND o.dest_id = n.dest_id GROUP BY ALL""")
def compare_stores(spark, d):
    x = B.links(spark, d)
    return links.compare_stores(x.where("lang_id <= 2").select("source_id", "dest_id").distinct(), x.where("lang_id >= 2").select("source_id", "dest_id").distinct())


@query(f"""WITH {CUST}, u AS (SELECT source_id AS a, dest_id AS b FROM ce UNION SELECT dest_id, source_id FROM ce), p AS (SELECT DISTINCT o_custkey AS a, c_nationkey::BIGINT AS b FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT p.a, p.b, (CASE WHEN u.a IS NULL THEN 2 ELSE 1 END)::INTEGER AS hops FROM p LEFT JOIN u ON u.a = p.a AND u.b = p.b""")
def hop_distance(spark, d):
    p = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b")).distinct()
    return links.hop_distance(p, customer_graph(spark, d))


# page views ------------------------------------------------------------------------------------------------------------


@query(f"WITH {B.VIEWS} SELECT page_id, sum(num_views)::BIGINT AS views FROM views WHERE tstamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY ALL")
def views_of_pages(spark, d):
    return pageviews.views_of_pages(B.views(spark, d), "2024-01-05 00:00:00", "2024-01-12 00:00:00")


@query(f"""WITH {B.VIEWS}, w(a, b) AS (VALUES (TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-09 00:00:00'), (TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-20 12:00:00'))
SELECT page_id, sum(num_views)::BIGINT AS views FROM views JOIN w ON tstamp BETWEEN a AND b GROUP BY ALL""")
def views_in_ranges(spark, d):
    return pageviews.views_in_ranges(B.views(spark, d), [("2024-01-03 00:00:00", "2024-01-09 00:00:00"), ("2024-01-08 00:00:00", "2024-01-20 12:00:00")])


@query(f"""WITH {B.VIEWS}, s AS (SELECT lang_id, page_id, sum(num_views)::BIGINT AS views FROM views WHERE tstamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL)
SELECT lang_id, row_number() OVER w::INTEGER AS rank, page_id, views FROM s WINDOW w AS (PARTITION BY lang_id ORDER BY views DESC, page_id) QUALIFY row_number() OVER w <= 10""")
def top_viewed(spark, d):
    return pageviews.top_pages(B.views(spark, d), "2024-01-02 00:00:00", "2024-01-25 00:00:00", 10)


@query(f"WITH {B.VIEWS} SELECT lang_id, count(DISTINCT tstamp) AS n, min(tstamp) AS first_hour, max(tstamp) AS last_hour FROM views GROUP BY ALL")
def loaded_hours(spark, d):
    return pageviews.loaded_hours(B.views(spark, d)).select("lang_id", F.size("hours").cast("long").alias("n"), F.element_at("hours", 1).alias("first_hour"), F.element_at("hours", -1).alias("last_hour"))


@query(f"""WITH {B.VIEWS}, g AS (SELECT l.lang_id::INTEGER AS lang_id, unnest(generate_series(TIMESTAMP '2024-01-25 01:00:00', TIMESTAMP '2024-02-02 23:00:00', INTERVAL 1 HOUR)) AS tstamp FROM (VALUES (1), (2), (3)) l(lang_id)),
h AS (SELECT DISTINCT lang_id, tstamp FROM views) SELECT lang_id, tstamp FROM g ANTI JOIN h USING (lang_id, tstamp)""")
def missing_hours(spark, d):
    asked = spark.sql("SELECT lang_id, timestamp'2024-01-25 00:30:00' AS start, timestamp'2024-02-03 00:00:00' AS end FROM VALUES (1), (2), (3) AS t(lang_id)")
    return pageviews.missing_hours(asked, B.views(spark, d))


@query(f"""WITH {B.VIEWS}, v AS (SELECT page_id, sum(num_views) AS n FROM views GROUP BY ALL) SELECT p_size::INTEGER AS category, sum(n)::BIGINT AS views, count(*) AS pages FROM v JOIN part ON p_partkey = page_id GROUP BY ALL""")
def views_by_category(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_size").cast("int").alias("category"))
    return pageviews.views_by_group(B.views(spark, d), m, "category")


@query("""SELECT event_type AS component, (user_id % 3)::INTEGER AS lang_id, count(*) AS num_records, sum((value > 90)::INTEGER)::BIGINT AS num_errors, 0::BIGINT AS level FROM events GROUP BY ALL
UNION ALL SELECT event_type, NULL, count(*), sum((value > 90)::INTEGER)::BIGINT, 1 FROM events GROUP BY ALL""")
def load_report(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("component"), (F.col("user_id") % 3).cast("int").alias("lang_id"), F.lit(1).cast("long").alias("num_records"), F.coalesce((F.col("value") > 90).cast("long"), F.lit(0)).alias("num_errors"), F.col("ts").alias("last_updated"))
    return audit.report(e).withColumn("level", F.col("level").cast("long"))
