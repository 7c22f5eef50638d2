"""Bounds that must not show: curves over many observations, long chains, large ties; and what is trained before what."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.api import Engine
from quillgraph.functions import ranking
from quillgraph.operators import evaluate, graph, normalize, phrases, similarity, spatial
from quillgraph.plans import training


def test_curves_hold_all_values_beyond_the_limit_of_points(spark):
    rows = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("s"))
    p = normalize.Percentile().fit(rows, "s", limit=50)
    n = np.array([r.n for r in rows.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()])
    assert p.xs.tolist() == list(range(10)) and np.allclose(p.ys, np.cumsum(n) / 100_001)


def test_curves_over_more_values_than_points(spark):
    rows = spark.range(60_000).select((F.col("id") * F.col("id")).cast("double").alias("s"), (F.col("id") / 60_000).alias("g"))
    got = normalize.observed(rows, "s", "g", limit=300)
    assert len(got) <= 300 and got[:, 2].sum() == 60_000 and got[:, 2].max() < 1200
    assert got[0, 0] == 0 and got[-1, 0] == 59_999.0**2
    p = normalize.Percentile().fit(rows, "s", limit=300)
    at = np.array([1000, 20_000, 45_000]) ** 2.0
    assert np.allclose(np.interp(at, p.xs, p.ys), np.array([1000, 20_000, 45_000]) / 60_000, atol=0.01)
    loess = normalize.Loess(log=True)
    assert np.allclose(loess.fit(rows, "s", "g", limit=3000).ys, loess.fit(rows, "s", "g", limit=100_000).ys, atol=0.02)


def test_weighted_points_are_repeated_ones():
    rng = np.random.default_rng(1)
    x, n = np.round(rng.normal(size=40), 1), rng.integers(1, 6, 40)
    y = x * 2 + rng.normal(size=40)
    a = normalize.Loess().fit_values(np.c_[np.repeat(x, n), np.repeat(y, n)])
    b = normalize.Loess().fit_values(np.c_[x, y, n])
    assert np.allclose(a.xs, b.xs) and np.allclose(a.ys, b.ys)
    assert np.allclose(normalize._quantiles(x, n, np.linspace(0, 1, 7)), np.quantile(np.repeat(x, n), np.linspace(0, 1, 7)))
    assert np.allclose(normalize.Percentile().fit_values(np.repeat(x, n)).ys, normalize.Percentile().fit_values(x, n).ys)


def test_long_chains_are_followed_to_their_end(spark):
    up = spark.createDataFrame([(i, i + 1) for i in range(80)], "child long, parent long")
    pages = spark.createDataFrame([(0, 1000)], "cat long, page_id long")
    got = graph.category_distances(pages, up, pages).collect()
    assert sorted((r.cat, r.dist) for r in got) == [(i, i + 1.0) for i in range(81)]
    down = graph.closest_categories(spark.createDataFrame([(80,)], "cat long"), up, pages).first()
    assert (down.cat, down.dist) == (80, 80.0)
    with pytest.raises(RuntimeError, match="not settled"):
        graph.category_distances(pages, up, pages, rounds=10)


def test_category_search_goes_up_and_then_down(spark):
    up = spark.createDataFrame([(1, 9), (2, 9), (3, 2)], "child long, parent long")
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (9, 90)], "cat long, page_id long")
    start = spark.createDataFrame([(10,)], "page_id long")
    got = lambda **how: sorted((r.page_id, r.dist) for r in graph.category_search(start, up, members, **how).collect())
    assert got() == [(10, 0.0), (11, 1.0), (20, 3.0), (30, 4.0), (90, 2.0)]
    assert got(children=False) == [(10, 0.0), (11, 1.0), (90, 2.0)]
    assert got(most=3) == [(10, 0.0), (11, 1.0), (90, 2.0)]
    assert got(valid=spark.createDataFrame([(30,)], "page_id long")) == [(10, 0.0), (30, 4.0)]


@pytest.mark.parametrize("kind", ["average", "max"])
def test_tie_ranks_are_those_of_windows(spark, kind):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, float(rng.randrange(5)), rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    window = ranking.rank_average if kind == "average" else ranking.rank_max
    want = sorted((tuple(r) for r in df.where("v is not null").withColumn("r", window(F.col("v"), ["k"])).collect()), key=str)
    got = sorted((tuple(r) for r in ranking.tie_ranks(df.where("v is not null"), "v", ["k"], "r", kind, bins=16).collect()), key=str)
    assert got == want
    whole = ranking.tie_ranks(df.where("v is not null").select("v"), "v", [], "r", kind, bins=16)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(tuple(r) for r in df.where("v is not null").select("v", window(F.col("v"), []).alias("r")).collect())


def test_metrics_are_trained_after_what_they_need():
    made = []

    def metric(name, *needs):
        return training.Metric(name, lambda gold, have: made.append((name, sorted(have))) or name.upper(), needs)

    metrics = {m.name: m for m in (metric("ensemble", "b", "a"), metric("a"), metric("b", "a"), metric("unasked"))}
    assert training.build(metrics, ["ensemble"], None) == {"a": "A", "b": "B", "ensemble": "ENSEMBLE"}
    assert made == [("a", []), ("b", ["a"]), ("ensemble", ["a", "b"])]
    assert training.build(metrics, ["b"], None, {"a": "old"})["a"] == "old"
    with pytest.raises(ValueError, match="need one another"):
        training.order({"x": metric("x", "y"), "y": metric("y", "x")}, ["x"])


def test_asked_pairs_have_the_scores_of_all_pairs(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame(sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(400)}), "source_id long, dest_id long")
    pages = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "page_id long, title string")
    engine = Engine(spark, pages, edges)
    pairs = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(1, 1), (1, 1)], "a long, b long")
    every = {"inlink": similarity.inlink(edges, 40), "outlink": similarity.outlink(edges), "syn-rank": similarity.syn_rank(edges, 40, edges)}
    for metric, all_pairs in every.items():
        known = {(r.a, r.b): r.score for r in all_pairs.collect()}
        for r in engine.similarity(pairs, metric).collect():
            assert r.score == pytest.approx(1.0 if r.a == r.b else known.get((r.a, r.b), 0.0))
        if metric != "syn-rank":
            best = {(r.a, r["rank"]): (r.b, round(r.score, 9)) for r in similarity.most_similar(all_pairs, 5).collect()}
            for r in engine.most_similar(pages.where("page_id < 7"), 5, metric).collect():
                assert best[r.a, r["rank"]] == (r.b, round(r.score, 9))


def test_regions_meet_by_edges_or_lie_within(spark):
    box = lambda k, x, y, w, h: (k, 0, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    schema = "region_id int, ring int, path array<struct<lon:double,lat:double>>"
    a = spark.createDataFrame([box(1, 0.0, 0.0, 10.0, 10.0), box(2, 30.0, 30.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([box(11, 9.0, 4.0, 5.0, 1.0), box(12, 3.0, 3.0, 1.0, 1.0), box(13, -5.0, -5.0, 60.0, 60.0), box(14, 10.0, 10.0, 2.0, 2.0), box(15, 11.0, 0.0, 1.0, 1.0), box(16, 4.0, -1.0, 1.0, 20.0)], schema)
    got = sorted((r.a, r.b) for r in spatial.intersecting(a, b).collect())
    assert got == [(1, 11), (1, 12), (1, 13), (1, 14), (1, 16), (2, 13)]


def test_folds_are_trained_on_the_others(spark):
    rows = spark.createDataFrame([(f"p{i}", "q", float(i % 9), float(i % 9)) for i in range(90)], "phrase1 string, phrase2 string, x double, gold double")
    sizes = []

    def fit(train):
        sizes.append(train.count())
        return lambda df: df.withColumn("score", F.col("x"))

    got = {r.fold: r for r in evaluate.k_fold(rows, fit, 3).collect()}
    assert set(got) == {None, 0, 1, 2} and got[None].n == 90 and sum(got[k].n for k in range(3)) == 90
    assert sum(sizes) == 180 and got[None].pearson == pytest.approx(1.0) and got[None].mae == 0


def test_robust_means_and_word_parts(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 100.0, 2.0],), ([],), ([5.0],)], "v array<double>")
    a, b, c = (r[0] for r in df.select(ranking.robust_mean(F.col("v"))).collect())
    w = np.exp(-((np.arange(5) - 2.0) ** 2) / 18)
    assert a == pytest.approx((np.sort([1.0, 2.0, 3.0, 100.0, 2.0]) * w).sum() / w.sum()) and b is None and c == 5.0
    parts = spark.createDataFrame([("abcde",), ("abc",), ("ab cd",)], "t string").select(phrases.split_variants(F.col("t"))).collect()
    assert [sorted(r[0]) for r in parts] == [["abc", "abcd", "bcde", "cde"], [], []]
