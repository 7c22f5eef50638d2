"""How good scores and lists are against gold judgements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import folds, rank_average, tie_ranks

RANKS = (1, 5, 10, 20, 50, 100, 500, 1000)


def similarity(df: DataFrame, keys: list[str], score: str = "score", gold: str = "gold") -> DataFrame:
    """(keys, n, missing, pearson, spearman, mae, rmse) over rows with a real score; others count as missing."""
    x = df.select(*keys, F.col(score).cast("double").alias("s"), F.col(gold).cast("double").alias("g"))
    ok = x.where("s is not null and not isnan(s) and abs(s) <> double('infinity')")
    ranked = tie_ranks(tie_ranks(ok, "s", keys, "rs"), "g", keys, "rg")
    d = F.col("s") - F.col("g")
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("s", "g").alias("pearson"), F.corr("rs", "rg").alias("spearman"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))
    total = x.groupBy(*keys).agg(F.count("*").alias("asked"))
    j = total.join(got, keys, "left") if keys else total.join(F.broadcast(got))
    return j.select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("asked") - F.coalesce("n", F.lit(0))).alias("missing"), "pearson", "spearman", "mae", "rmse")


def rolled_up(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, mean absolute error and correlation by all keys, by prefixes of them, and overall; level tells which."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("gold"))).alias("mae"), F.corr("score", "gold").alias("pearson"), F.grouping_id().cast("long").alias("level"))


def group_gold(gold: DataFrame, threshold: float | None = None) -> DataFrame:
    """(phrase1, phrase2, similarity, n): repeated judgements of a pair by their mean."""
    g = gold.groupBy("phrase1", "phrase2").agg(F.avg("similarity").alias("similarity"), F.count("*").alias("n"))
    return g if threshold is None else g.where(F.col("similarity") >= threshold)


def majority_id(gold: DataFrame, phrase: str, ident: str) -> DataFrame:
    """The id that most judgements give a phrase, the smallest in ties."""
    c = gold.groupBy(phrase, ident).agg(F.count("*").alias("n"))
    return c.groupBy(phrase).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(ident))).alias("b")).select(phrase, F.col(f"b.{ident}").alias(ident))


def _discount(rank):
    return F.when(rank == 1, 1.0).otherwise(1 / F.log(rank + 1.0))


def ndcg(guesses: DataFrame, gold: DataFrame, key: str = "q") -> DataFrame:
    """(q, ndcg, n): gains at the ranks of judged guesses, against the same gains in their best order at the same ranks.

    ``guesses`` has (q, id, rank), ``gold`` (q, id, gain).
    """
    seen = guesses.join(gold, [key, "id"])
    a = Window.partitionBy(key).orderBy("rank", "id")
    b = Window.partitionBy(key).orderBy(F.desc("gain"), "id")
    seen = seen.withColumn("place", F.row_number().over(a)).withColumn("best", F.row_number().over(b))
    ranks = seen.select(key, F.col("place").alias("best"), F.col("rank").alias("at"))
    j = seen.join(ranks, [key, "best"])
    return j.groupBy(key).agg((F.sum(F.col("gain") * _discount(F.col("rank"))) / F.sum(F.col("gain") * _discount(F.col("at")))).alias("ndcg"), F.count("*").alias("n"))


def penalised_ndcg(guesses: DataFrame, gold: DataFrame, key: str = "q") -> DataFrame:
    """As ndcg(), with judged ids that the list lacks at rank 3 * its length, and false gains at half the least."""
    size = guesses.groupBy(key).agg(F.count("*").alias("len"))
    low = gold.groupBy(key).agg((F.min("gain") / 2).alias("low"))
    lost = gold.join(guesses.select(key, "id"), [key, "id"], "left_anti").join(size, key).select(key, "id", (3 * F.col("len")).cast("int").alias("rank"))
    every = guesses.select(key, "id", F.col("rank").cast("int").alias("rank")).unionByName(lost)
    shifted = gold.join(low, key).select(key, "id", (F.col("gain") - F.col("low")).alias("gain"))
    return ndcg(every, shifted, key)


def precision_recall(guesses: DataFrame, gold: DataFrame, ranks: tuple[int, ...] = RANKS, threshold: float = 0.6, key: str = "q") -> DataFrame:
    """(q, at, precision, recall): over judged guesses; an id is relevant from ``threshold`` on."""
    g = gold.withColumn("good", (F.col("gain") >= threshold).cast("int"))
    total = g.groupBy(key).agg(F.sum("good").alias("total"))
    seen = guesses.join(g, [key, "id"]).withColumn("at", F.explode(F.array(*map(F.lit, ranks)))).where("rank <= at")
    p = seen.groupBy(key, "at").agg(F.count("*").alias("n"), F.sum("good").alias("hit"))
    return p.join(total, key).select(key, "at", (F.col("hit") / F.col("n")).alias("precision"), F.when(F.col("total") > 0, F.col("hit") / F.col("total")).alias("recall"))


def overall_ndcg(per_query: DataFrame) -> DataFrame:
    """(ndcg): the mean weighted by judged guesses less one."""
    return per_query.agg((F.sum(F.col("ndcg") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("ndcg"))


def worst(df: DataFrame, keys: list[str], k: int, score: str = "score", gold: str = "gold") -> DataFrame:
    """The k rows of each group whose ranks by score and by gold differ most."""
    d = rank_average(F.col(score), keys) - rank_average(F.col(gold), keys)
    x = df.withColumn("difference", d)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("difference")), *[F.col(c) for c in df.columns if c not in keys])
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def synthetic_gold(lines: DataFrame, stop_ranks: int = 20, targets: int = 50, candidates: int = 500, seed_ratio: float = 2.0) -> DataFrame:
    """(phrase1, phrase2, pmi, place): pairs of words with their mutual information, at ranks that grow geometrically.

    ``lines`` has (line_id, words). The words are the most frequent ones after ``stop_ranks``, so that the pairs of a
    line are bounded by the two lists.
    """
    w = lines.select("line_id", F.explode(F.array_distinct("words")).alias("w"))
    n = lines.count()
    freq = w.groupBy("w").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w").offset(stop_ranks).limit(candidates)
    freq = freq.withColumn("r", F.row_number().over(Window.orderBy(F.desc("f"), "w")))  # at most ``candidates`` rows
    c = w.join(F.broadcast(freq), "w")
    pair = c.where(F.col("r") <= targets).select("line_id", F.col("w").alias("phrase1"), F.col("f").alias("f1")).join(c.select("line_id", F.col("w").alias("phrase2"), F.col("f").alias("f2")), "line_id").where("phrase1 <> phrase2")
    p = pair.groupBy("phrase1", "phrase2", "f1", "f2").agg(F.count("*").alias("both")).withColumn("pmi", F.log(F.col("both") * F.lit(float(max(n, 1))) / (F.col("f1") * F.col("f2"))))
    ranked = p.withColumn("place", F.row_number().over(Window.partitionBy("phrase1").orderBy(F.desc("pmi"), "phrase2")))
    step = F.log(F.col("place").cast("double")) / math.log(seed_ratio)
    before = F.when(F.col("place") == 1, -1).otherwise(F.floor(F.log(F.col("place") - 1.0) / math.log(seed_ratio)))
    return ranked.where(F.floor(step) != before).select("phrase1", "phrase2", "pmi", "place")


def k_fold(gold: DataFrame, fit, k: int = 7, key: tuple[str, ...] = ("phrase1", "phrase2"), seed: int = 0) -> DataFrame:
    """(fold, n, missing, pearson, spearman, mae, rmse): each fold scored by what was trained on the others; fold null for all together.

    ``fit`` takes the training rows and returns a function that adds a column ``score`` to rows; gold scores are in ``gold``.
    """
    dealt, out = folds(gold, k, list(key), seed), None
    for i in range(k):
        apply = fit(dealt.where(F.col("fold") != i))
        part = apply(dealt.where(F.col("fold") == i)).select("fold", "score", "gold")
        out = part if out is None else out.unionByName(part)
    each = similarity(out, ["fold"])
    return each.unionByName(similarity(out, []).select(F.lit(None).cast("int").alias("fold"), *each.columns[1:]))


def most_similar_report(guesses: DataFrame, gold: DataFrame, ranks: tuple[int, ...] = RANKS, threshold: float = 0.6, key: str = "q") -> DataFrame:
    """(measure, at, value): mean precision and recall of the lists at each rank, both NDCGs weighted by judged guesses, and how many were judged."""
    pr = precision_recall(guesses, gold, ranks, threshold, key).groupBy("at").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    rows = pr.select(F.expr("stack(2, 'precision', precision, 'recall', recall) as (measure, value)"), "at").select("measure", "at", "value")
    for name, per in (("ndcg", ndcg(guesses, gold, key)), ("penalised ndcg", penalised_ndcg(guesses, gold, key))):
        rows = rows.unionByName(overall_ndcg(per).select(F.lit(name).alias("measure"), F.lit(None).cast("int").alias("at"), F.col("ndcg").alias("value")))
    seen = guesses.join(gold, [key, "id"]).agg(F.count("*").cast("double").alias("value"))
    return rows.unionByName(seen.select(F.lit("judged").alias("measure"), F.lit(None).cast("int").alias("at"), "value"))
