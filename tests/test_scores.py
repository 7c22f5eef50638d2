"""Page views, the sphere, normalizers, ensembles, evaluation, the knowledge base, streams, queries against SQL."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ensemble, evaluate, normalize, pageviews, spatial, wikidata


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hour_grid_and_incremental_load(spark):
    asked = spark.sql("SELECT 1 AS lang_id, timestamp'2024-01-01 00:20:00' AS start, timestamp'2024-01-01 01:20:00' AS end")
    assert [str(r.tstamp) for r in pageviews.hour_grid(asked).collect()] == ["2024-01-01 01:00:00"]
    raw = spark.sql("SELECT 1 AS lang_id, 'A' AS title, timestamp'2024-01-01 01:00:00' AS tstamp, 3L AS num_views UNION ALL SELECT 1, 'missing', timestamp'2024-01-01 01:00:00', 4L")
    pages = spark.createDataFrame([(1, "A", 10)], "lang_id int, title string, page_id long")
    none = spark.createDataFrame([], "lang_id int, page_id long, tstamp timestamp, num_views long")
    new = pageviews.load_missing(raw, pages, none, asked)
    assert rows(new.select("page_id", "num_views")) == [(10, 3)]
    assert pageviews.load_missing(raw, pages, new, asked).count() == 0


def test_sphere(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(rng.uniform(-180, 180)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(250)] + [(900, 179.99, 10.0), (901, -179.99, 10.0), (902, 20.0, 89.9), (903, -160.0, 89.9)]
    p = spark.createDataFrame(pts, "id long, lon double, lat double")

    def dist(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * spatial.RADIUS * math.asin(math.sqrt(min(h, 1)))

    for far in (400_000.0, 5_000_000.0):
        assert {(r.a, r.b) for r in spatial.within(p, p, far).collect()} == {(a[0], b[0]) for a in pts for b in pts if dist(a, b) <= far}
    q = p.where("id in (3, 900, 902)")
    got = {(r.a, r["rank"]): r.b for r in spatial.nearest(q, p, 4, 200_000.0).collect()}
    for a in pts:
        if a[0] in (3, 900, 902):
            assert [got[a[0], k + 1] for k in range(4)] == [b[0] for b in sorted((b for b in pts if b[0] != a[0]), key=lambda b: dist(a, b))[:4]]


def test_regions(spark):
    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    reg = spark.createDataFrame([("a", 0, sq(0.0, 0.0, 10.0)), ("a", 1, sq(4.0, 4.0, 2.0)), ("b", 0, sq(10.0005, 0.0, 5.0)), ("c", 0, sq(50.0, 50.0, 1.0))], "region_id string, ring int, path array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 12.0, 1.0), (4, 51.05, 50.5), (5, 80.0, 80.0)], "id long, lon double, lat double")
    assert rows(spatial.containing(p, reg)) == [(1, "a"), (3, "b")]
    assert rows(spatial.contained(p, reg)) == [(1, "a"), (3, "b"), (4, "c")]
    assert rows(spatial.bordering(reg.where("ring = 0"))) == [("a", "b")]
    c = {r.region_id: (r.lon, r.lat) for r in spatial.centre(reg).collect()}
    assert c["a"] == pytest.approx((5.0, 5.0))
    g = spark.range(1).select(spatial.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"), spatial.geodesic(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("b")).first()
    assert g.a == pytest.approx(110574.4, abs=1) and g.b == pytest.approx(math.pi * spatial.RADIUS, rel=1e-3)


def test_normalizers(spark):
    v = [1, 4, 3.2, 5, 7.9, 10.5, 11.2, 6.5]
    df = spark.createDataFrame([(float(x), float(x) / 12) for x in v] + [(None, 0.5), (float("nan"), 0.3)], "score double, gold double")
    n = normalize.Percentile().fit(df, "score")
    at = lambda x: spark.range(1).select(n.apply(F.lit(float(x))).alias("y")).first().y
    assert at(1.0) == pytest.approx(0.1111, abs=1e-4) and at(11.2) == pytest.approx(0.8888, abs=1e-4)
    assert 0 < at(0) < 0.111 and 0.8889 < at(20) < 1
    r = normalize.Range().fit(df, "score")
    assert [round(x.y, 4) for x in df.where("score in (1, 11.2)").select(r.apply(F.col("score")).alias("y")).collect()] == [0.0, 1.0]
    assert normalize.missing_mean(df, "score", "gold").first()[0] == pytest.approx(0.4)
    lo = normalize.Loess().fit(df, "score", "gold")
    ys = [x.y for x in df.where("score is not null and not isnan(score)").orderBy("score").select(lo.apply(F.col("score")).alias("y")).collect()]
    assert ys == sorted(ys) and lo.missing == pytest.approx(0.4)


def test_ensembles(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=60), rng.normal(size=60)
    a = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "a long, b long, score double")
    b = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(y)], "a long, b long, score double")
    gold = spark.createDataFrame([(i, float(2 * u - 3 * v + 1)) for i, (u, v) in enumerate(zip(x, y, strict=True))], "a long, gold double")
    w = ensemble.wide(ensemble.stack({"x": a, "y": b}), ["x", "y"]).join(gold, "a")
    assert np.allclose(ensemble.Linear(["x", "y"]).fit(w).w, [2, -3, 1], atol=1e-6)
    assert ensemble.even(ensemble.stack({"x": a, "y": b})).where("a = 0").first().score == pytest.approx((x[0] + y[0]) / 2)


def test_list_evaluation(spark):
    gold = {"tart": 0.6, "orange": 0.91, "black": 0.5, "shoe": 0.0, "honeycrisp": 0.95, "mac": 0.8}
    guess = ["mac", "x1", "orange", "tart", "x2", "honeycrisp", "black"]
    g = spark.createDataFrame([("apple", k, v) for k, v in gold.items()], "q string, id string, gain double")
    s = spark.createDataFrame([("apple", k, i + 1) for i, k in enumerate(guess)], "q string, id string, rank int")
    at = {r.at: (r.precision, r.recall) for r in evaluate.precision_recall(s, g, (1, 2, 5), 0.7).collect()}
    assert at[1] == (1.0, pytest.approx(1 / 3)) and at[2] == (1.0, pytest.approx(1 / 3)) and at[5] == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    seen = [(i + 1, gold[k]) for i, k in enumerate(guess) if k in gold]
    disc = lambda r: 1 if r == 1 else 1 / math.log(r + 1)
    want = sum(x * disc(r) for r, x in seen) / sum(x * disc(r) for (r, _), x in zip(seen, sorted((x for _, x in seen), reverse=True), strict=True))
    assert evaluate.ndcg(s, g).first().ndcg == pytest.approx(want)
    assert 0 < evaluate.penalised_ndcg(s, g).first().ndcg < 1


def test_knowledge_base(spark):
    def claim(kind, value, snak="value"):
        return {"id": f"x{value}", "rank": "preferred", "mainsnak": {"property": "P1", "snaktype": snak, "datatype": "d", "datavalue": {"type": kind, "value": value}}}

    item = {"id": "Q5", "type": "item", "labels": {"en": {"language": "en", "value": "Five"}}, "claims": {"P31": [claim("wikibase-entityid", {"entity-type": "item", "numeric-id": 6})], "P625": [claim("globecoordinate", {"latitude": 1.5, "longitude": 2.5, "globe": "http://x/Q2"})], "P9": [claim("string", "s")], "P10": [claim("time", {"time": "+2020"})]}, "sitelinks": {"enwiki": {"site": "enwiki", "title": "Five"}, "commonswiki": {"site": "c", "title": "x"}}}
    prop = {"id": "P31", "type": "property", "labels": {"de": {"language": "de", "value": "ist"}}, "aliases": {"en": [{"language": "en", "value": "is a"}]}}
    lines = spark.createDataFrame([("[",), (json.dumps(item) + ",",), (json.dumps(prop),), ("not json",), ("]",)], "value string")
    e = wikidata.parse(lines).cache()
    st = wikidata.statements(e).cache()
    assert {(r.prop_id, r.val_type, r.val_str) for r in st.where("prop_id <> 625").collect()} == {(31, "ITEM", "6"), (9, "STRING", "s"), (10, "TIME", "+2020")} and st.first()["rank"] == 2
    assert rows(wikidata.points(st)) == [(5, 2.5, 1.5)]
    assert rows(wikidata.sitelinks(e)) == [(5, "en", "Five")]
    assert rows(wikidata.property_by_name(wikidata.labels(e), wikidata.aliases(e), "Is A")) == [(31,)]
    loc = {r.prop_id: (r.item, r.property, r.value) for r in wikidata.localise(st, wikidata.labels(e), ["en"]).collect()}
    assert loc[31] == ("Five", "ist", "unknown") and loc[9] == ("Five", "unknown", "s")
    assert wikidata.keep_entities(e, ["en"]).count() == 1


SAME = ["inlink_most_similar", "pagerank", "closest_categories", "phrase_senses", "link_probability", "text_search", "top_viewed", "skeletal_links", "nearest_points", "percentile_normalized", "list_evaluation", "localised_statements", "streamed_views"]


@pytest.mark.parametrize("name", SAME)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = sorted(c[0] for c in cur.description)
    order = [[c[0] for c in cur.description].index(n) for n in names]
    got = entry.queries()[name](spark, d)
    assert sorted(got.columns) == names
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_parts_by_name(spark):
    from quillgraph.api import Engine
    from quillgraph.plans import registry

    assert registry.get("normalizer", "range") is normalize.Range and "lsh-forest" in registry.names("neighbours")
    with pytest.raises(ValueError):
        registry.register("normalizer", "range", object)
    e = spark.createDataFrame([(3, 1), (4, 1), (4, 2), (5, 2), (6, 2), (5, 1), (6, 1)], "source_id long, dest_id long")
    pages = spark.createDataFrame([(i, f"T{i}") for i in range(1, 7)], "page_id long, title string")
    engine = Engine(spark, pages, e)
    assert rows(engine.most_similar(pages.where("page_id = 1"), 1).select("a", "b")) == [(1, 2)]
    s = {(r.a, r.b): r.score for r in engine.similarity(spark.createDataFrame([(1, 1), (1, 6)], "a long, b long"), "inlink").collect()}
    assert s == {(1, 1): 1.0, (1, 6): 0.0}
    assert engine.page_rank(pages).count() == 6


def test_distance_levels_take_every_scored_pair(spark, tmp_path):
    from quillgraph.plans import catalogue

    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table([(1, 0), (2, 0), (8, 0)], "c_custkey long, c_nationkey int", "customer")
    table([(5, 1)], "o_orderkey long, o_custkey long", "orders")
    table([(5, 2), (5, 8), (5, 1)], "l_orderkey long, l_suppkey long", "lineitem")
    # no key is a multiple of 20; 1 and 2 lie 600 km apart, 1 and 8 more than 4,000
    assert rows(catalogue.QUERIES["relatedness_by_distance"](spark, str(tmp_path))) == [(2, 2, 0.5)]


def test_estimated_ordinals_are_of_all_pairs(spark, tmp_path):
    from quillgraph.plans import catalogue

    ids = [1, 2, 3, 8, 20, 21]
    spark.createDataFrame([(k,) for k in ids], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = rows(catalogue.QUERIES["estimated_ordinals"](spark, str(tmp_path)))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a in ids for b in ids if a != b]
    # of five others the furthest is the edge
    assert all(sorted(o for a, _, o in got if a == k) == [0, 1, 2, 3, 5] for k in ids)


def test_ordinals_within_are_ranks_of_the_pairs_within(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, float(rng.integers(-18, 18) * 10), float(rng.integers(-9, 10) * 10)) for i in range(300)], "id long, lon double, lat double")
    a = p.where("id % 3 = 0")
    want = spatial.ordinal(spatial.within(a, p, 3_000_000.0).where("a <> b").withColumn("metres", F.round("metres", 3)))
    got = rows(spatial.ordinals_within(a, p, 3_000_000.0))
    assert got == rows(want) and len(got) > 300


def test_within_sends_lists_not_pairs(spark):
    p = spark.range(4000).select("id", (F.col("id") % 2 / 10).alias("lon"), F.lit(1.0).alias("lat"))
    plan = spatial.within(p, p, 900_000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Join")
