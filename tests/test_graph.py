"""Links, graphs, concepts and vectors on small constructed tables."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import concepts, filters, graph, knn, links, similarity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_complete_dag(spark):
    e = spark.range(1, 41).select(F.col("id").alias("source_id")).crossJoin(spark.range(1, 41).select(F.col("id").alias("dest_id"))).where("source_id < dest_id")
    assert rows(links.neighbours(e, 7)) == [(i,) for i in range(8, 41)]
    assert rows(links.neighbours(e, 7, out=False)) == [(i,) for i in range(1, 7)]
    d = {r.page_id: (r.out_degree, r.in_degree) for r in links.degrees(e).collect()}
    assert d[1] == (39, 0) and d[40] == (0, 39)


def test_redirects(spark):
    r = spark.createDataFrame([(0, 5), (1, 0), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7)], "src_page_id long, dest_page_id long")
    got = dict(rows(links.resolve_chains(r)))
    assert got[0] == got[1] == got[2] == got[3] == 5 and got[4] == -1 and got[7] == got[8] == -1


def test_prime_categories(spark):
    primes = [p for p in range(2, 100) if all(p % q for q in range(2, p))]
    m = spark.createDataFrame([(p, i) for p in primes for i in range(1, 101) if i % p == 0], "category_id long, article_id long")
    n = {r.category_id: r.n for r in m.groupBy("category_id").agg(F.count("*").alias("n")).collect()}
    assert n[5] == 20 and n[7] == 14
    tree = spark.createDataFrame([(p, 1) for p in primes], "child long, parent long")
    pages = m.select(F.col("category_id").alias("cat"), F.col("article_id").alias("page_id"))
    got = {r.page_id: (r.cat, r.dist) for r in graph.closest_categories(spark.createDataFrame([(3,), (5,)], "cat long"), tree, pages).collect()}
    assert got[15] == (3, 0.0) and got[25] == (5, 0.0) and 7 not in got
    up = {(r.page_id, r.cat): r.dist for r in graph.category_distances(spark.createDataFrame([(15,)], "page_id long"), tree, pages).collect()}
    assert up == {(15, 3): 1.0, (15, 5): 1.0, (15, 1): 2.0}


def test_link_similarities(spark):
    e = spark.createDataFrame([(3, 1), (4, 1), (4, 2), (5, 2), (6, 2), (5, 1), (6, 1)], "source_id long, dest_id long")
    i = {(r.a, r.b): r.score for r in similarity.inlink(e, 6).collect()}
    assert i[1, 2] == pytest.approx(1 - (math.log(4) - math.log(3)) / (math.log(6) - math.log(3)))
    o = {(r.a, r.b): r.score for r in similarity.google(similarity.link_vectors(e), 6).collect()}
    assert o[3, 4] == pytest.approx(1 - (math.log(2) - math.log(1)) / (math.log(6) - math.log(1))) and o[3, 4] == o[4, 3]


def test_sparse_cosine(spark):
    a, b = {7: 0.3, 9: 0.5, 12: 0.2, 5: 0.7, 6: 0.8, 2: 0.1}, {5: 0.8, 3: 0.1, 2: 0.2, 4: 0.4, 7: 0.5}
    v = spark.createDataFrame([(1, k, x) for k, x in a.items()] + [(2, k, x) for k, x in b.items()], "row_id long, col_id long, value double")
    want = sum(x * b.get(k, 0) for k, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {(r.a, r.b): r.score for r in similarity.cosine(v).collect()}
    assert got == {(1, 2): pytest.approx(want), (2, 1): pytest.approx(want)}


def test_pagerank_against_loop(spark):
    e = [(1, 2), (2, 3), (3, 1), (4, 1), (2, 4), (5, 3), (1, 6)]
    df = spark.createDataFrame(e, "source_id long, dest_id long")
    out = {s: sum(1 for x, _ in e if x == s) for s, _ in e}
    rank, first, got = {s: 1 / len(out) for s in out}, {s: 1 / len(out) for s in out}, {}
    for _ in range(5):
        got = {}
        for s, t in e:
            got[t] = got.get(t, 0) + rank.get(s, 0) / out[s] if s in rank else got.get(t, 0)
        rank = first | {t: 0.15 / 5 + 0.85 * x for t, x in got.items()}
    res = {r.page_id: r["rank"] for r in graph.pagerank(df, iterations=5).collect()}
    assert set(res) == set(rank) and all(res[k] == pytest.approx(rank[k]) for k in rank)
    std = graph.pagerank(df, iterations=3, standard=True)
    assert std.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(rows(graph.components(e, spark.createDataFrame([(200,)], "node long"))))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[200] == 200
    assert graph.components(e.limit(0)).count() == 0


def test_aligned_concepts(spark):
    ills = [(1, 10, 2, 20), (2, 20, 3, 30)] + [(1, 11, 2, 21), (1, 11, 2, 22), (1, 11, 2, 23), (3, 31, 2, 21)]
    pages = [(1, 10), (2, 20), (3, 30), (1, 11), (2, 21), (2, 22), (2, 23), (3, 31), (4, 40)]
    got = {(r.lang_id, r.page_id): r.univ_id for r in concepts.aligned(spark.createDataFrame(ills, "source_lang int, source_id int, dest_lang int, dest_id int"), spark.createDataFrame(pages, "lang_id int, page_id int"), lang_count=3).collect()}
    assert len(got) == len(pages)
    assert got[1, 10] == got[2, 20] == got[3, 30]
    assert got[3, 31] == got[2, 21] != got[1, 11]  # a page with three targets in a language has no vote


def test_filters(spark):
    p = spark.createDataFrame([(1, 1, "A", 0, False, False), (1, 2, "B", 0, True, False), (2, 3, "C", 14, False, False)], "lang_id int, page_id int, title string, name_space int, is_redirect boolean, is_disambig boolean")
    assert filters.PageFilter().apply(p).count() == filters.PageFilter(langs=[]).apply(p).count() == 3
    assert rows(filters.PageFilter(langs=[1], is_redirect=False).apply(p).select("page_id")) == [(1,)]
    assert rows(p.where(filters.normal_page()).select("page_id")) == [(1,)]


def test_indexes_reach_their_recall(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no vectors here")
    v = spark.read.parquet(path).select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0")
    exact = knn.brute_force(v, q, 10, query_bytes=8000).cache()
    assert exact.where("rank = 1").count() == q.count()
    for index, how in ((knn.RandomProjection(), {"traversal": 2000}), (knn.LshForest(), {"traversal": 8000}), (knn.KMeansTree(), {"probes": 300}), (knn.TwoMeansTree(), {"probes": 48})):
        assert knn.recall(index.fit(v).search(v, q, 10, **how), exact).first()[0] >= 0.9, index


def test_block_pairs_equal_the_joins_and_send_no_pairs(spark, monkeypatch):
    import random

    rng = random.Random(3)
    near = [(rng.randrange(40), rng.randrange(25)) for _ in range(300)]
    far = [(10_000 + rng.randrange(3000), rng.randrange(30)) for _ in range(400)] + [(-5, 3)]
    e = spark.createDataFrame(sorted(set(near + far)), "source_id long, dest_id long")
    told = lambda df: {(r.a, r.b): None if r.score is None else round(r.score, 9) for r in df.collect()}
    ins, outs = similarity.link_vectors(e, out=False), similarity.link_vectors(e, out=True, weighted=True, logged=True)
    i, o = similarity.google(ins, 1000), similarity.cosine(outs)
    for least, most in ((2048, 32768), (64, 64), (2048, 2048)):
        monkeypatch.setattr(similarity, "_LEAST", least)
        monkeypatch.setattr(similarity, "_MOST", most)
        got = similarity.outlink(e)
        assert told(got) == told(o)
    assert told(similarity.inlink(e, 1000)) == told(i)
    assert told(similarity.milne_witten_pairs(e, 1000)) == told(similarity.milne_witten(i, o))
    best = lambda df: sorted((r.a, r["rank"], r.b) for r in df.collect())
    assert best(similarity.outlink_most_similar(e, 3)) == best(similarity.most_similar(o, 3))
    # after the blocks met in one Python step, nothing is summed by pair
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "keys=[a" not in plan
