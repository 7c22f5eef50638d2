"""Queries over scores, gold judgements, the knowledge base and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranking
from ..operators import concepts, ensemble, evaluate, graph, normalize, wikidata
from ..session import table
from . import bind as B
from .bind import r
from .catalogue import query

GOLD = "gold AS MATERIALIZED (SELECT doc_id, quality::DOUBLE AS gold, lang, source, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _gold(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("gold"), "lang", "source", F.col("n_chars").cast("double").alias("score"))


@query(f"WITH {GOLD}, m AS (SELECT min(score) AS a, max(score) AS b FROM gold) SELECT doc_id, round((score - a) / (b - a), 6) AS score FROM gold, m")
def range_normalized(spark, d):
    g = _gold(spark, d)
    return g.select("doc_id", F.round(normalize.Range().fit(g, "score").apply(F.col("score")), 6).alias("score"))


@query(f"WITH {GOLD}, m AS (SELECT min(1 + score) AS c FROM gold) SELECT doc_id, round(CASE WHEN 1 + score < c THEN 0 ELSE ln(c + score) END, 6) AS score FROM gold, m")
def log_normalized(spark, d):
    g = _gold(spark, d)
    return g.select("doc_id", F.round(normalize.Log().fit(g, "score").apply(F.col("score")), 6).alias("score"))


@query(f"WITH {GOLD} SELECT doc_id, round((rank() OVER (ORDER BY score) - 1 + count(*) OVER (PARTITION BY score))::DOUBLE / (count(*) OVER () + 1), 6) AS score FROM gold")
def percentile_normalized(spark, d):
    g = _gold(spark, d)
    return g.select("doc_id", F.round(normalize.Percentile().fit(g, "score").apply(F.col("score")), 6).alias("score"))


@query()
def loess_normalized(spark, d):
    g = _gold(spark, d)
    return g.select("doc_id", F.round(normalize.Loess(log=True).fit(g, "score", "gold").apply(F.col("score")), 6).alias("score"))


@query(f"""WITH {GOLD}, x AS (SELECT *, ln(1 + row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)) AS lr FROM gold), s AS (SELECT regr_slope(gold, lr) AS b, regr_intercept(gold, lr) AS a FROM x) SELECT doc_id, round(a + b * lr, 5) AS score FROM x, s""")
def rank_normalized(spark, d):
    """Gold scores as a linear function of the logarithm of the rank."""
    g = _gold(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")))
    w = normalize.least_squares(g, [F.log1p("rank")], F.col("gold"))
    return g.select("doc_id", F.round(F.log1p("rank") * float(w[0]) + float(w[1]), 5).alias("score"))


def _stacked(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.avg("l_quantity").alias("q"), F.avg(F.col("l_discount") * 100).alias("x"), F.max("l_extendedprice").alias("gold"))
    big = F.when(F.col("q") > 10, F.col("q"))
    return t, ensemble.stack({"quantity": t.select("a", "b", big.alias("score")), "discount": t.select("a", "b", F.col("x").alias("score"))})


STACK = "t AS MATERIALIZED (SELECT l_suppkey AS a, l_partkey AS b, avg(l_quantity) AS q, avg(l_discount * 100) AS x, max(l_extendedprice) AS gold FROM lineitem GROUP BY ALL)"


@query(f"WITH {STACK} SELECT a, b, round(CASE WHEN q > 10 THEN (q + x) / 2 ELSE x END, 6) AS score FROM t")
def even_ensemble(spark, d):
    return ensemble.even(_stacked(spark, d)[1]).withColumn("score", F.round("score", 6))


@query(f"WITH {STACK} SELECT a, b, round(CASE WHEN q > 10 THEN (3 * q + x) / 4 ELSE x END, 6) AS score FROM t")
def weighted_ensemble(spark, d):
    return ensemble.weighted(_stacked(spark, d)[1], {"quantity": 3.0, "discount": 1.0}).withColumn("score", F.round("score", 6))


@query(f"""WITH {STACK}, w AS (SELECT a, b, gold, CASE WHEN q > 10 THEN q ELSE 5 END AS q, x FROM t), m AS (SELECT var_pop(q) AS vq, var_pop(x) AS vx, covar_pop(q, x) AS qx, covar_pop(q, gold) AS qg, covar_pop(x, gold) AS xg, avg(q) AS aq, avg(x) AS ax, avg(gold) AS ag FROM w),
c AS (SELECT (vx * qg - qx * xg) / (vq * vx - qx * qx) AS bq, (vq * xg - qx * qg) / (vq * vx - qx * qx) AS bx, aq, ax, ag FROM m) SELECT a, b, round(ag + bq * (q - aq) + bx * (x - ax), 3) AS score FROM w, c""")
def linear_ensemble(spark, d):
    t, s = _stacked(spark, d)
    w = ensemble.wide(s, ["quantity", "discount"], {"quantity": (5.0, 100.0), "discount": (0.0, 100.0)}).join(t.select("a", "b", "gold"), ["a", "b"])
    return ensemble.Linear(["quantity", "discount"]).fit(w).apply(w).select("a", "b", r("score", 3))


@query(f"""WITH {STACK}, w AS (SELECT a, b, gold, CASE WHEN q > 10 THEN q ELSE 5 END AS q, x FROM t), c AS (SELECT corr(q, gold) / stddev_samp(q) AS cq, corr(x, gold) / stddev_samp(x) AS cx FROM w) SELECT a, b, round(cq * q + cx * x, 5) AS score FROM w, c""")
def correlation_ensemble(spark, d):
    t, s = _stacked(spark, d)
    w = ensemble.wide(s, ["quantity", "discount"], {"quantity": (5.0, 100.0), "discount": (0.0, 100.0)}).join(t.select("a", "b", "gold"), ["a", "b"])
    return ensemble.Correlation(["quantity", "discount"]).fit(w).apply(w).select("a", "b", r("score", 5))


@query(f"""WITH {GOLD}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY lang ORDER BY gold) + (count(*) OVER (PARTITION BY lang, gold) - 1) / 2.0::DOUBLE AS rg FROM gold)
SELECT lang, count(*) AS n, 0::BIGINT AS missing, round(corr(score, gold), 6) AS pearson, round(corr(rs, rg), 6) AS spearman, round(avg(abs(score - gold)), 4) AS mae, round(sqrt(avg((score - gold) ^ 2)), 4) AS rmse FROM k GROUP BY lang""")
def similarity_evaluation(spark, d):
    e = evaluate.similarity(_gold(spark, d), ["lang"])
    return e.select("lang", "n", F.col("missing").cast("long").alias("missing"), r("pearson"), r("spearman"), r("mae", 4), r("rmse", 4))


@query(f"""WITH {GOLD} SELECT lang, source, count(*) AS n, round(avg(abs(score - gold)), 4) AS mae, grouping(lang, source)::BIGINT AS level FROM gold GROUP BY ROLLUP (lang, source)""")
def evaluation_roll_up(spark, d):
    return evaluate.rolled_up(_gold(spark, d), ["lang", "source"]).select("lang", "source", "n", r("mae", 4), "level")


_G = "g0 AS (SELECT l_suppkey AS q, l_partkey AS id, max(l_discount) + 0.01 AS gain, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL), g AS MATERIALIZED (SELECT q, id, gain, row_number() OVER (PARTITION BY q ORDER BY p DESC, id) AS rank FROM g0)"


def _guesses(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("id")).agg((F.max("l_discount") + 0.01).alias("gain"), F.max("l_extendedprice").alias("p"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "id")))


@query(f"""WITH {_G}, o AS (SELECT q, id, rank, gain, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS place, row_number() OVER (PARTITION BY q ORDER BY gain DESC, id) AS best FROM g WHERE rank <= 30 AND id % 3 > 0)
SELECT a.q, round(sum(a.gain * CASE WHEN a.rank = 1 THEN 1 ELSE 1 / ln(a.rank + 1) END) / sum(a.gain * CASE WHEN b.rank = 1 THEN 1 ELSE 1 / ln(b.rank + 1) END), 6) AS ndcg, count(*) AS n FROM o a JOIN o b ON b.q = a.q AND b.place = a.best GROUP BY a.q""")
def list_evaluation(spark, d):
    """The first thirty of each list against judgements of two thirds of the ids."""
    g = _guesses(spark, d)
    return evaluate.ndcg(g.where("rank <= 30").select("q", "id", "rank"), g.where("id % 3 > 0").select("q", "id", "gain")).withColumn("ndcg", F.round("ndcg", 6))


@query(f"""WITH {_G}, v(k) AS (VALUES (1), (5), (10), (20), (50), (100), (500), (1000)), t AS (SELECT q, nullif(sum((gain >= 0.08)::INTEGER), 0) AS total FROM g GROUP BY q) SELECT g.q, k::INTEGER AS at, round(avg((gain >= 0.08)::INTEGER), 6) AS precision, round(sum((gain >= 0.08)::INTEGER)::DOUBLE / any_value(total), 6) AS recall FROM g JOIN t USING (q) CROSS JOIN v WHERE rank <= k GROUP BY g.q, k""")
def precision_recall(spark, d):
    g = _guesses(spark, d)
    return evaluate.precision_recall(g.select("q", "id", "rank"), g.select("q", "id", "gain"), threshold=0.08).select("q", "at", r("precision"), r("recall"))


@query("SELECT l_returnflag AS phrase1, l_linestatus || l_linenumber::VARCHAR AS phrase2, round(avg(l_discount), 6) AS similarity, count(*) AS n FROM lineitem GROUP BY ALL")
def grouped_gold(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("phrase1"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("phrase2"), F.col("l_discount").alias("similarity"))
    return evaluate.group_gold(g).withColumn("similarity", F.round("similarity", 6))


@query("SELECT l_returnflag || l_linenumber::VARCHAR AS phrase, arg_min(l_suppkey, (-n, l_suppkey)) AS page_id FROM (SELECT l_returnflag, l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def majority_ids(spark, d):
    g = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("phrase"), F.col("l_suppkey").alias("page_id"))
    return evaluate.majority_id(g, "phrase", "page_id")


@query("""WITH l AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM documents), x AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM l), n AS (SELECT count(*)::DOUBLE AS n FROM l),
k0 AS (SELECT w, count(*) AS f FROM x GROUP BY ALL), f AS MATERIALIZED (SELECT w, f, r FROM (SELECT w, f, row_number() OVER (ORDER BY f DESC, w) - 20 AS r FROM k0) WHERE r BETWEEN 1 AND 500), c AS MATERIALIZED (SELECT doc_id, w, f, r FROM x JOIN f USING (w)),
p AS (SELECT a.w AS phrase1, b.w AS phrase2, ln(count(*) * any_value(n.n) / (any_value(a.f) * any_value(b.f))) AS pmi FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.w <> b.w CROSS JOIN n WHERE a.r <= 50 GROUP BY a.w, b.w),
k AS (SELECT *, row_number() OVER (PARTITION BY phrase1 ORDER BY pmi DESC, phrase2) AS place FROM p) SELECT phrase1, phrase2, round(pmi, 6) AS pmi, place::INTEGER AS place FROM k WHERE place IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)""")
def synthetic_gold(spark, d):
    lines = B.docs(spark, d).select(F.col("doc_id").alias("line_id"), F.split(F.lower("text"), r"\s+").alias("words"))
    return evaluate.synthetic_gold(lines).withColumn("pmi", F.round("pmi", 6))


@query(f"WITH {GOLD} SELECT doc_id, count(*) OVER (PARTITION BY lang ORDER BY score RANGE UNBOUNDED PRECEDING) AS rank_max, max(score) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM gold")
def ranks_and_runs(spark, d):
    g = ranking.tie_ranks(_gold(spark, d), "score", ["lang"], "rank_max", "max")
    return g.select("doc_id", F.col("rank_max").cast("long").alias("rank_max"), ranking.running_max(F.col("score"), F.col("doc_id"), ["lang"], 0.0).alias("running"))


# the knowledge base ------------------------------------------------------------------------------------------------------


def _entities(spark, d):
    """Parts as items with labels, statements and sitelinks, and the property of the statements, in lines of JSON."""
    lab = lambda lang, v: F.struct(F.lit(lang).alias("language"), v.alias("value"))
    m = lambda *kv: F.create_map(*kv)
    p = table(spark, d, "part")
    value = F.to_json(F.struct(F.lit("item").alias("entity-type"), F.col("p_size").alias("numeric-id")))
    claim = F.struct(F.concat(F.lit("q$"), F.col("p_partkey").cast("string")).alias("id"), F.lit("normal").alias("rank"), F.struct(F.lit("P31").alias("property"), F.lit("value").alias("snaktype"), F.lit("wikibase-item").alias("datatype"), F.struct(F.lit("wikibase-entityid").alias("type"), F.from_json(value, "`entity-type` string, `numeric-id` int").alias("value")).alias("datavalue")).alias("mainsnak"))
    item = F.struct(
        F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("id"), F.lit("item").alias("type"), F.when(F.col("p_partkey") % 5 == 0, m(F.lit("de"), lab("de", F.col("p_name")))).otherwise(m(F.lit("en"), lab("en", F.col("p_name")), F.lit("de"), lab("de", F.col("p_type")))).alias("labels"),
        m(F.lit("P31"), F.array(claim)).alias("claims"), m(F.lit("enwiki"), F.struct(F.lit("enwiki").alias("site"), F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string")).alias("title")), F.lit("commonswiki"), F.struct(F.lit("commonswiki").alias("site"), F.lit("x").alias("title"))).alias("sitelinks"),
    )
    is_a = spark.createDataFrame([('{"id": "P31", "type": "property", "labels": {"en": {"language": "en", "value": "instance of"}}},',)], "value string")
    return wikidata.parse(p.select(F.concat(F.to_json(item), F.lit(",")).alias("value")).unionByName(is_a))


@query("SELECT p_partkey::INTEGER AS entity_id, 31 AS prop_id, 'ITEM' AS val_type, p_size::VARCHAR AS val_str, 1::SMALLINT AS rank FROM part")
def entity_statements(spark, d):
    return wikidata.statements(_entities(spark, d)).select("entity_id", "prop_id", "val_type", "val_str", "rank")


@query("SELECT p_partkey::INTEGER AS entity_id, p_name AS label FROM part UNION ALL SELECT 31, 'instance of'")
def entity_labels(spark, d):
    """Labels in the first language that has one."""
    return wikidata.best_label(wikidata.labels(_entities(spark, d)), ["en", "de"]).select("entity_id", "label")


@query("SELECT p.p_partkey::INTEGER AS entity_id, p.p_name AS item, 'instance of' AS property, coalesce(v.p_name, 'unknown') AS value FROM part p LEFT JOIN part v ON v.p_partkey = p.p_size")
def localised_statements(spark, d):
    e = graph.cut(_entities(spark, d))
    return wikidata.localise(wikidata.statements(e), wikidata.labels(e), ["en", "de"]).select("entity_id", "item", "property", "value")


@query(f"WITH {B.CONCEPTS} SELECT univ_id, page_id FROM concepts WHERE lang_id = 2 AND univ_id IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def pages_with_value(spark, d):
    st = wikidata.statements(_entities(spark, d))
    return wikidata.pages_with_value(st, B.concepts(spark, d), 31, "7", 2)


@query("SELECT 1::INTEGER AS lang_id, p_partkey AS page_id, (CASE WHEN p_partkey % 10 = 0 THEN 14 ELSE 0 END)::INTEGER AS name_space, p_partkey::INTEGER AS univ_id FROM part WHERE p_partkey % 4 = 0")
def sitelink_concepts(spark, d):
    langs = spark.createDataFrame([("en", 1)], "lang string, lang_id int")
    return concepts.from_sitelinks(wikidata.sitelinks(_entities(spark, d)), langs, B.pages(spark, d))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def typed_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# streams -------------------------------------------------------------------------------------------------------------------


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS low FROM events) SELECT date_trunc('hour', ts) AS tstamp, user_id AS page_id, count(*) AS num_views FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= low GROUP BY ALL")
def streamed_views(spark, d):
    """Hourly views by a stream that takes all there is; hours within the watermark's reach are still open."""
    import uuid

    from ..operators.graph import shared_folder
    from ..streaming import views

    path = f"{d}/events.parquet"
    base = f"{shared_folder(spark)}/quillgraph-stream-{uuid.uuid4().hex[:12]}"
    # a pattern, since a stream takes a plain path for a folder
    hits = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    views.run_available(views.hourly(hits), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("tstamp timestamp, page_id long, num_views long").parquet(f"{base}/out")
