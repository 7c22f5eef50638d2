"""Queries over graphs, the sphere and dense vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts, evaluate, graph, knn, spatial
from ..operators.links import top
from ..operators.similarity import cosine_dense
from ..session import table
from . import bind as B
from .bind import r
from .catalogue import query
from .q_links import CUST, customer_graph


def _rank_sql(rounds: int = 20) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT source_id AS id, 1.0::DOUBLE / (SELECT count(*) FROM od) AS rank FROM od)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"n{k} AS MATERIALIZED (SELECT dest_id AS id, 0.15::DOUBLE / (SELECT count(DISTINCT dest_id) FROM ce) + 0.85::DOUBLE * sum(rank / n) AS rank FROM ce JOIN od USING (source_id) JOIN r{k - 1} ON r{k - 1}.id = source_id GROUP BY ALL), "
            f"r{k} AS MATERIALIZED (SELECT * FROM n{k} UNION ALL SELECT * FROM r0 ANTI JOIN n{k} USING (id))"
        )
    return f"WITH {CUST}, od AS MATERIALIZED (SELECT source_id, count(*) AS n FROM ce GROUP BY ALL), {', '.join(steps)} SELECT id AS page_id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql())
def pagerank(spark, d):
    return graph.pagerank(customer_graph(spark, d)).select("page_id", r("rank", 9))


def _standard_sql(rounds: int = 20) -> str:
    n = "(SELECT count(*) FROM nodes)"
    steps = [f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / {n} AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT source_id FROM od)), r{k} AS MATERIALIZED (SELECT nodes.id, 0.15::DOUBLE / {n} + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT lost FROM l{k}) / {n}) AS rank "
            f"FROM nodes LEFT JOIN (SELECT dest_id AS id, sum(rank / n) AS got FROM ce JOIN od USING (source_id) JOIN r{k - 1} ON r{k - 1}.id = source_id GROUP BY ALL) g USING (id))"
        )
    return f"WITH {CUST}, nodes AS MATERIALIZED (SELECT source_id AS id FROM ce UNION SELECT dest_id FROM ce), od AS MATERIALIZED (SELECT source_id, count(*) AS n FROM ce GROUP BY ALL), {', '.join(steps)} SELECT id AS page_id, round(rank, 9) AS rank FROM r{rounds}"


@query(_standard_sql())
def pagerank_standard(spark, d):
    """With teleport for all and the mass of dead ends spread."""
    return graph.pagerank(customer_graph(spark, d), standard=True).select("page_id", r("rank", 9))


COSTS = f"""{B.TREE}, cats AS MATERIALIZED (SELECT c AS cat, count(DISTINCT p_partkey) AS n FROM (SELECT child AS c FROM tree UNION SELECT parent FROM tree UNION SELECT DISTINCT p_size::BIGINT FROM part) LEFT JOIN part ON p_size = c GROUP BY ALL),
deg AS (SELECT child, count(*) AS k FROM tree GROUP BY ALL), q0 AS MATERIALIZED (SELECT cat, (1.0::DOUBLE + n) / (SELECT count(*) + sum(n) FROM cats)::DOUBLE AS pr FROM cats), """ + ", ".join(
    f"q{k} AS MATERIALIZED (SELECT cats.cat, 0.15::DOUBLE / (SELECT count(*) FROM cats) + coalesce(got, 0) AS pr FROM cats LEFT JOIN (SELECT parent AS cat, sum(0.85::DOUBLE * pr / k) AS got FROM tree JOIN deg USING (child) JOIN q{k - 1} ON q{k - 1}.cat = child GROUP BY ALL) g USING (cat))"
    for k in range(1, 21)
)


@query(f"WITH {COSTS} SELECT cat, round(pr, 9) AS pr, round(1 / -ln(pr), 6) AS cost FROM q20")
def category_costs(spark, d):
    m = B.members(spark, d).select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))
    return graph.category_costs(B.category_tree(spark, d), m).select("cat", r("pr", 9), r("cost"))


def _tops(spark):
    return spark.createDataFrame([(2,), (3,), (5,), (7,)], "cat long")


@query(f"""WITH RECURSIVE {B.TREE}, reach AS (SELECT cat AS owner, cat AS node, 0 AS dist FROM (VALUES (2::BIGINT), (3), (5), (7)) v(cat) UNION SELECT owner, child, dist + 1 FROM reach JOIN tree ON parent = node WHERE child <> parent AND dist < 30),
best AS (SELECT node, owner, dist FROM reach QUALIFY row_number() OVER (PARTITION BY node ORDER BY dist, owner) = 1)
SELECT p_partkey AS page_id, owner AS cat, dist::DOUBLE AS dist FROM part JOIN best ON node = p_size""")
def closest_categories(spark, d):
    """To which of four top categories each article is nearest."""
    m = B.members(spark, d).select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))
    return graph.closest_categories(_tops(spark), B.category_tree(spark, d), m)


@query(f"""WITH RECURSIVE {B.TREE}, reach AS (SELECT DISTINCT p_partkey AS page_id, p_size::BIGINT AS cat, 1 AS dist FROM part UNION SELECT page_id, parent, dist + 1 FROM reach JOIN tree ON child = cat WHERE child <> parent AND dist < 30)
SELECT page_id, cat, min(dist)::DOUBLE AS dist FROM reach GROUP BY ALL""")
def category_distances(spark, d):
    """Every category above every article with its distance."""
    m = B.members(spark, d).select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))
    return graph.category_distances(m, B.category_tree(spark, d), m)


@query("""SELECT c_custkey + 1000000 AS node, c_nationkey::BIGINT AS component FROM customer UNION SELECT DISTINCT c_nationkey::BIGINT, c_nationkey::BIGINT FROM customer""")
def connected_components(spark, d):
    """Stars around hubs: customers and their nations."""
    e = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    return graph.components(e)


@query(f"""WITH RECURSIVE {B.REDIRECTS}, e AS MATERIALIZED (SELECT src_page_id AS a, dest_page_id AS b FROM redirects UNION SELECT dest_page_id, src_page_id FROM redirects),
c AS (SELECT a AS node, a AS x FROM (SELECT a FROM e) UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.x) SELECT node, min(x) AS component FROM c GROUP BY ALL""")
def redirect_components(spark, d):
    """Chains: pages that redirects hold together."""
    return graph.components(B.redirects(spark, d).select(F.col("src_page_id").alias("a"), F.col("dest_page_id").alias("b")))


@query("""WITH e AS (SELECT p_partkey AS src, 1 AS src_lang, p_partkey + 1000000 AS dst, 2 AS dst_lang FROM part UNION SELECT p_partkey, 1, (p_partkey // 3) + 2000000, 3 FROM part UNION SELECT (p_partkey // 3) + 2000000, 3, p_partkey + 1000000, 2 FROM part)
, o AS (SELECT src, dst_lang, count(DISTINCT dst) AS v FROM e GROUP BY ALL), i AS (SELECT dst, count(DISTINCT src_lang) AS v FROM e GROUP BY ALL), b AS (SELECT dst, src_lang, count(DISTINCT src) AS v FROM e GROUP BY ALL)
SELECT e.src, e.dst FROM e JOIN o ON o.src = e.src AND o.dst_lang = e.dst_lang JOIN i ON i.dst = e.dst JOIN b ON b.dst = e.dst AND b.src_lang = e.src_lang WHERE o.v <= 2 AND i.v >= 0 AND b.v <= 2""")
def split_ambiguous(spark, d):
    """Links between languages that enough votes support."""
    p, one, two, three = F.col("p_partkey"), F.lit(1).alias("src_lang"), F.lit(2).alias("dst_lang"), F.lit(3)
    t = table(spark, d, "part")
    a = t.select(p.alias("src"), one, (p + 1_000_000).alias("dst"), two)
    b = t.select(p.alias("src"), one, (F.floor(p / 3).cast("long") + 2_000_000).alias("dst"), three.alias("dst_lang"))
    c = t.select((F.floor(p / 3).cast("long") + 2_000_000).alias("src"), three.alias("src_lang"), (p + 1_000_000).alias("dst"), two)
    return graph.split_component(a.unionByName(b).unionByName(c).distinct(), lang_count=3).select("src", "dst")


@query("""SELECT 1::INTEGER AS lang_id, p_partkey::INTEGER AS page_id, 4294967296 + p_partkey AS univ_id FROM part UNION ALL SELECT 2, p_partkey + 100000, 4294967296 + p_partkey FROM part UNION ALL SELECT 3, p_partkey + 200000, 4294967296 + p_partkey FROM part""")
def aligned_concepts(spark, d):
    """Concepts from inter-language links over three languages."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("k"))
    link = lambda a, x, b, y: p.select(F.lit(a).alias("source_lang"), (F.col("k") + x).alias("source_id"), F.lit(b).alias("dest_lang"), (F.col("k") + y).alias("dest_id"))
    pages = p.select(F.lit(1).alias("lang_id"), F.col("k").alias("page_id")).union(p.select(F.lit(2), F.col("k") + 100_000)).union(p.select(F.lit(3), F.col("k") + 200_000))
    return concepts.aligned(link(1, 0, 2, 100_000).unionByName(link(3, 200_000, 2, 100_000)), pages)


@query("""SELECT n_nationkey + 100::BIGINT AS owner, n_nationkey + 100::BIGINT AS node, 0::INTEGER AS hops FROM nation UNION ALL SELECT n_nationkey + 100, n_regionkey, 1 FROM nation
UNION ALL SELECT a.n_nationkey + 100, b.n_nationkey + 100, 2 FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey""")
def bounded_hops(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    return graph.hops(n.select(F.col("a").alias("owner"), F.col("a").alias("node")), n, 30)


# the sphere --------------------------------------------------------------------------------------------------------------

_M = B.METRES.format(a="x", b="y")


@query(f"WITH {B.POINTS} SELECT x.id AS a, y.id AS b, round({_M}, 3) AS metres FROM points x JOIN points y ON x.id <> y.id WHERE x.id % 20 = 0 AND {_M} <= 900000")
def points_within(spark, d):
    """Pairs of places at 900 km or less; the places asked about are a stated set."""
    p = B.points(spark, d)
    return spatial.within(p.where("id % 20 = 0"), p, 900_000.0).where("a <> b").select("a", "b", r("metres", 3))


@query(f"WITH {B.POINTS} SELECT x.id AS a, row_number() OVER w::INTEGER AS rank, y.id AS b, round({_M}, 3) AS metres FROM points x JOIN points y ON x.id <> y.id WHERE x.id % 20 = 0 WINDOW w AS (PARTITION BY x.id ORDER BY round({_M}, 6), y.id) QUALIFY row_number() OVER w <= 5")
def nearest_points(spark, d):
    p = B.points(spark, d)
    return spatial.nearest(p.where("id % 20 = 0"), p, 5).select("a", "rank", "b", r("metres", 3))


@query(f"""WITH {B.POINTS}, m AS (SELECT x.id AS a, y.id AS b, {_M} AS m FROM points x JOIN points y ON x.id <> y.id WHERE x.id % 20 = 0 AND {_M} <= 900000)
SELECT a, b, rank() OVER (PARTITION BY a ORDER BY round(m, 3))::INTEGER AS ordinal FROM m""")
def ordinal_distance(spark, d):
    p = B.points(spark, d)
    return spatial.ordinals_within(p.where("id % 20 = 0"), p, 900_000.0)


def _boxes(spark):
    """Countries as boxes of 30 by 20 degrees, every other one with a hole."""
    x, y = F.col("i") % 12 * 30.0 - 180, F.floor(F.col("i") / 12) * 20.0 - 80
    c = spark.range(96).withColumnRenamed("id", "i").select(F.col("i").cast("int").alias("region_id"), x.alias("x"), y.cast("double").alias("y"))
    ring = lambda a, b, w, h: F.array(*[F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat")) for dx, dy in ((a, b), (a + w, b), (a + w, b + h), (a, b + h))])
    outer = c.select("region_id", F.lit(0).alias("ring"), ring(0.0, 0.0, 30.0, 20.0).alias("path"))
    return outer.unionByName(c.where("region_id % 2 = 0").select("region_id", F.lit(1).alias("ring"), ring(10.0, 5.0, 10.0, 10.0).alias("path")))


@query(f"""WITH {B.POINTS}, g AS (SELECT id, lon, lat, floor((lon + 180) / 30)::INTEGER AS cx, floor((lat + 80) / 20)::INTEGER AS cy FROM points), h AS (SELECT *, cy * 12 + cx AS region_id, lon + 180 - cx * 30 AS dx, lat + 80 - cy * 20 AS dy FROM g WHERE lat >= -80 AND lat < 80)
SELECT id, region_id::INTEGER AS region_id FROM h WHERE NOT (region_id % 2 = 0 AND dx >= 10 AND dx < 20 AND dy >= 5 AND dy < 15)""")
def containing_regions(spark, d):
    return spatial.containing(B.points(spark, d), _boxes(spark))


@query(f"""WITH {B.VIEWS}, {B.POINTS}, g AS (SELECT id, (floor((lat + 80) / 20) * 12 + floor((lon + 180) / 30))::INTEGER AS region_id FROM points WHERE lat >= -80 AND lat < 80 AND NOT ((floor((lat + 80) / 20) * 12 + floor((lon + 180) / 30)) % 2 = 0
 AND lon + 180 - floor((lon + 180) / 30) * 30 >= 10 AND lon + 180 - floor((lon + 180) / 30) * 30 < 20 AND lat + 80 - floor((lat + 80) / 20) * 20 >= 5 AND lat + 80 - floor((lat + 80) / 20) * 20 < 15)),
v AS (SELECT page_id, sum(num_views) AS n FROM views GROUP BY ALL) SELECT region_id, sum(n)::BIGINT AS views, count(*) AS pages FROM v JOIN g ON g.id = page_id GROUP BY ALL""")
def views_by_region(spark, d):
    from ..operators import pageviews

    held = spatial.containing(B.points(spark, d), _boxes(spark)).select(F.col("id").alias("page_id"), "region_id")
    return pageviews.views_by_group(B.views(spark, d), held, "region_id")


@query("SELECT x.i::INTEGER AS a, y.i::INTEGER AS b FROM range(96) x(i) JOIN range(96) y(i) ON x.i < y.i AND abs(x.i % 12 - y.i % 12) <= 1 AND abs(x.i // 12 - y.i // 12) <= 1")
def bordering_regions(spark, d):
    return spatial.bordering(_boxes(spark).where("ring = 0"))


def _geodesic_sql(rounds: int = 12) -> str:
    """Vincenty's inverse formula, round by round."""
    flat, wide = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    low, keep = f"((1 - {flat}) * {wide})", "id, x1, y1, x2, y2, su1, cu1, su2, cu2"
    at = f"v0 AS MATERIALIZED (SELECT *, sin(atan((1 - {flat}) * tan(y1))) AS su1, cos(atan((1 - {flat}) * tan(y1))) AS cu1, sin(atan((1 - {flat}) * tan(y2))) AS su2, cos(atan((1 - {flat}) * tan(y2))) AS cu2, x2 - x1 AS lam FROM (SELECT p.id, radians(p.lon) AS x1, radians(p.lat) AS y1, radians(q.lon) AS x2, radians(q.lat) AS y2 FROM points p JOIN points q ON q.id + 1 = p.id))"
    for k in range(1, rounds + 1):
        at += f""", a{k} AS (SELECT {keep}, lam, sqrt((cu2 * sin(lam)) ^ 2 + (cu1 * su2 - su1 * cu2 * cos(lam)) ^ 2) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM v{k - 1}),
b{k} AS (SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss > 0 THEN cu1 * cu2 * sin(lam) / ss ELSE 0 END AS sa FROM a{k}), c{k} AS (SELECT *, 1 - sa ^ 2 AS ca2, CASE WHEN 1 - sa ^ 2 > 0 THEN cs - 2 * su1 * su2 / (1 - sa ^ 2) ELSE 0 END AS cm FROM b{k}),
d{k} AS (SELECT *, {flat} / 16 * ca2 * (4 + {flat} * (4 - 3 * ca2)) AS k FROM c{k}), v{k} AS MATERIALIZED (SELECT {keep}, ss, cs, sig, ca2, cm, x2 - x1 + (1 - k) * {flat} * sa * (sig + k * ss * (cm + k * cs * (-1 + 2 * cm ^ 2))) AS lam, lam AS was FROM d{k})"""
    return f"""WITH {B.POINTS}, {at}, q AS (SELECT *, ca2 * ({wide} ^ 2 - {low} ^ 2) / {low} ^ 2 AS q FROM v{rounds}), e AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS e, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS f FROM q),
g AS (SELECT id, abs(lam - was) AS change, {low} * e * (sig - f * ss * (cm + f / 4 * (cs * (-1 + 2 * cm ^ 2) - f / 6 * cm * (-3 + 4 * ss ^ 2) * (-3 + 4 * cm ^ 2)))) AS got, 2 * 6372800.0::DOUBLE * asin(sqrt(least(1.0, sin((y2 - y1) / 2) ^ 2 + cos(y1) * cos(y2) * sin((x2 - x1) / 2) ^ 2))) AS sphere FROM e)
SELECT id, round(CASE WHEN change < 1e-9 AND isfinite(got) THEN got ELSE sphere END, 3) AS metres FROM g"""


@query(_geodesic_sql())
def geodesic_distances(spark, d):
    """Metres on the ellipsoid between each place and the one before it."""
    p = B.points(spark, d)
    j = p.join(p.select((F.col("id") + 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "id")
    return j.select("id", F.round(spatial.geodesic(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


def _hops_sql(neighbours: int = 100, most: int = 30) -> str:
    steps = ["h0 AS MATERIALIZED (SELECT id AS owner, id AS node, 0 AS hops FROM points WHERE id % 20 = 0)", "f0 AS (SELECT * FROM h0)"]
    for k in range(1, most + 1):
        steps.append(f"f{k} AS MATERIALIZED (SELECT DISTINCT owner, node, {k} AS hops FROM (SELECT owner, g.b AS node FROM f{k - 1} x JOIN g ON g.a = x.node) ANTI JOIN h{k - 1} USING (owner, node))")
        steps.append(f"h{k} AS MATERIALIZED (SELECT * FROM h{k - 1} UNION ALL SELECT * FROM f{k})")
    near = f"nb AS (SELECT x.id AS a, y.id AS b FROM points x JOIN points y ON x.id <> y.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY round({_M}, 6), y.id) <= {neighbours})"
    return f"WITH {B.POINTS}, {near}, g AS MATERIALIZED (SELECT a, b FROM nb UNION SELECT b, a FROM nb), {', '.join(steps)} SELECT owner, node, hops::INTEGER AS hops FROM h{most}"


@query(_hops_sql(100, 12))
def neighbour_graph_hops(spark, d):
    """Hops over the graph of the hundred nearest places, from every twentieth."""
    p = B.points(spark, d)
    near = graph.cut(spatial.nearest(p, p, 100))
    return spatial.graph_distance(p.where("id % 20 = 0").select(F.col("id").alias("owner"), F.col("id").alias("node")), near, 30)


# dense vectors -----------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


DENSE = """v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
nn AS MATERIALIZED (SELECT q.id AS query_id, c.id, list_cosine_similarity(q.v, c.v) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0)"""


@query(f"WITH {DENSE} SELECT query_id, row_number() OVER w::INTEGER AS rank, id, round(score, 6) AS score FROM nn WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) QUALIFY row_number() OVER w <= 10")
def dense_neighbours(spark, d):
    """Exact: every twentieth vector against all."""
    v = _vectors(spark, d)
    return knn.brute_force(v, v.where("id % 20 = 0"), 10).select("query_id", "rank", "id", r("score"))


@query("SELECT p.id AS a, q.id AS b, round(coalesce(list_cosine_similarity(p.v, q.v), 0), 6) AS score FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) p JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) q ON q.id = p.id + 1")
def dense_cosine(spark, d):
    v = _vectors(spark, d)
    j = v.select(F.col("id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("embedding").alias("y")), "a")
    return j.select("a", "b", F.round(cosine_dense(F.col("x"), F.col("y")), 6).alias("score"))


def _approximate(spark, d, index, **how):
    """Every twentieth vector's neighbours by an index, with as much of it searched as gives nine of ten of the exact ones."""
    v = _vectors(spark, d)
    q = v.where("id % 20 = 0")
    return index.fit(v).search(v, q, 10, **how).select("query_id", "rank", "id", r("score"))


@query()
def random_projection_neighbours(spark, d):
    return _approximate(spark, d, knn.RandomProjection(), share=0.25)


@query()
def lsh_forest_neighbours(spark, d):
    return _approximate(spark, d, knn.LshForest(trees=10), share=2.0)


@query()
def kmeans_tree_neighbours(spark, d):
    return _approximate(spark, d, knn.KMeansTree(), share=0.7)


@query()
def two_means_tree_neighbours(spark, d):
    return _approximate(spark, d, knn.TwoMeansTree(), share=0.75)


@query(f"""WITH {DENSE}, t AS (SELECT query_id, id, score FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10), l AS (SELECT vec_id AS id, label FROM embeddings), g AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, t.id) AS rank, (a.label = b.label)::INTEGER AS good FROM t JOIN l a ON a.id = query_id JOIN l b ON b.id = t.id)
SELECT query_id AS q, k::INTEGER AS "at", coalesce(sum(good) FILTER (rank <= k), 0)::DOUBLE / count(*) FILTER (rank <= k) AS precision, CASE WHEN sum(good) > 0 THEN coalesce(sum(good) FILTER (rank <= k), 0)::DOUBLE / sum(good) END AS recall FROM g CROSS JOIN (VALUES (1), (5), (10)) v(k) GROUP BY query_id, k""")
def neighbour_precision(spark, d):
    """How many of the nearest have the same label."""
    v, lab = _vectors(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    n = knn.brute_force(v, v.where("id % 20 = 0"), 10)
    g = n.select(F.col("query_id").alias("q"), "id", "rank").join(lab, "id").join(lab.select(F.col("id").alias("q"), F.col("label").alias("mine")), "q").select("q", "id", "rank", (F.col("label") == F.col("mine")).cast("int").alias("gain"))
    return evaluate.precision_recall(g.select("q", "id", "rank"), g.select("q", "id", "gain"), (1, 5, 10))


@query("""SELECT l_partkey AS k, row_number() OVER w::INTEGER AS rank, l_orderkey, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 3""")
def top_of_each(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return top(t, 3, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], ["k"]).select("k", "rank", "l_orderkey", "l_linenumber")
