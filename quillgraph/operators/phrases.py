"""Phrases and pages: counts, pruning, resolution, link probability, search, disambiguation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .links import top


def counts(anchors: DataFrame, normal=None) -> DataFrame:
    """(phrase, page_id, count) from (anchor, page_id); phrases in their normal form."""
    phrase = (normal or T.normalise)(F.col("anchor"))
    return anchors.select(phrase.alias("phrase"), "page_id").where("phrase <> ''").groupBy("phrase", "page_id").agg(F.count("*").alias("count"))


def prune(c: DataFrame, key: str, value: str, min_count: int = 1, max_rank: int | None = None, min_share: float = 0.0) -> DataFrame:
    """(key, value, count, total): of each key the values of sufficient rank, count and share; the total is that before pruning."""
    w = Window.partitionBy(key)
    r = c.withColumn("total", F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), F.asc(value))))
    keep = (F.col("count") >= min_count) & (F.col("count") / F.col("total") >= min_share)
    keep = keep if max_rank is None else keep & (F.col("rank") <= max_rank)
    return r.where(keep).select(key, value, "count", "total", "rank")


def prune_normalised(c: DataFrame, key: str, surface: str, **how) -> DataFrame:
    """Surfaces with one normal form are merged under the most frequent of them, then pruned."""
    merged = c.withColumn("norm", T.normalise(F.col(surface))).groupBy(key, "norm").agg(F.max_by(surface, F.struct("count", F.col(surface))).alias(surface), F.sum("count").alias("count"))
    return prune(merged, key, surface, **how)


def resolve(c: DataFrame, max_pages: int = 10) -> DataFrame:
    """(phrase, rank, page_id, prob): the pages that a phrase means."""
    return prune(c, "phrase", "page_id", max_rank=max_pages).select("phrase", "rank", "page_id", (F.col("count") / F.col("total")).alias("prob"))


def describe(c: DataFrame, max_phrases: int = 10) -> DataFrame:
    """(page_id, rank, phrase, prob): the phrases that name a page."""
    return prune(c, "page_id", "phrase", max_rank=max_phrases).select("page_id", "rank", "phrase", (F.col("count") / F.col("total")).alias("prob"))


def by_title(phrases: DataFrame, titles: DataFrame) -> DataFrame:
    """(phrase, page_id, prob): exact titles, with certainty."""
    return phrases.join(titles.select(F.col("title").alias("phrase"), "page_id"), "phrase").withColumn("prob", F.lit(1.0))


def cascade(*analysers: DataFrame) -> DataFrame:
    """For each phrase the rows of the first analyser that has some."""
    out = analysers[0]
    for nxt in analysers[1:]:
        out = out.unionByName(nxt.join(out.select("phrase").distinct(), "phrase", "left_anti"))
    return out


#: Phrases that are looked up in memory, at most.
_FEW = 1_000_000


def few(known: DataFrame) -> tuple[DataFrame, bool]:
    """The phrases, stored, and whether they are so few that texts can look them up where they are; counted up to there only."""
    from .graph import cut

    known = cut(known)
    return known, known.limit(_FEW + 1).count() <= _FEW


def look_up(grams: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of ``grams`` whose phrase is known; where phrases are few, n-grams that aren't known are never sent."""
    known, small = few(known)
    return grams.join(F.broadcast(known) if small else known, "phrase", how)


def link_probability(docs: DataFrame, linked: DataFrame, longest: int = 3) -> DataFrame:
    """(phrase, n_links, n_seen, prob): links / (occurrences + 3) of known phrases, from (doc_id, text) and (phrase, n_links).

    N-grams are made of the lengths that known phrases have, and those that aren't known go before they are counted.
    """
    lengths = [r[0] for r in linked.select(F.size(F.split("phrase", " ")).alias("n")).where(F.col("n") <= longest).distinct().collect()]  # ``longest`` numbers at most
    toks, grams = docs.select(T.tokens(F.lower("text")).alias("t")), None
    for n in sorted(lengths) or [1]:
        g = toks.select(F.explode(T.ngrams(F.col("t"), n, n)).alias("phrase"))
        grams = g if grams is None else grams.unionByName(g)
    grams = look_up(grams, linked.select("phrase").distinct(), "left_semi").groupBy("phrase").agg(F.count("*").alias("n_seen"))
    return linked.join(grams, "phrase", "left").select("phrase", "n_links", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), (F.col("n_links") / (F.coalesce("n_seen", F.lit(0)) + 3)).alias("prob"))


def term_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)"""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(T.tokens(F.lower(F.col(text_col)))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def search(index: DataFrame, queries: DataFrame, n_docs: int, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): sqrt(tf) * idf ** 2 / sqrt(terms of the document), summed, from (query_id, term)."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    size = index.groupBy("doc_id").agg(F.sum("tf").alias("size"))
    idf = 1 + F.log(F.lit(float(n_docs)) / (F.col("df") + 1))
    hit = queries.distinct().join(df, "term").join(index, "term").join(size, "doc_id")
    s = hit.groupBy("query_id", "doc_id").agg(F.sum(F.sqrt(F.col("tf").cast("double")) * idf * idf / F.sqrt(F.col("size").cast("double"))).alias("score"))
    return top(s, k, [F.desc(F.round("score", 9)), F.asc("doc_id")], ["query_id"]).select("query_id", "rank", "doc_id", "score")


def tf_idf(index: DataFrame, n_docs: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """(row_id, col, value) tf-idf vectors of unit length."""
    df = index.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    v = index.join(df, "term").select(F.col("doc_id").alias("row_id"), F.col("term").alias("col_id"), (F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("value")).where("value > 0")
    n = v.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return v.join(n, "row_id").select("row_id", "col_id", (F.col("value") / F.col("norm")).alias("value"))


def concept_vectors(vectors: DataFrame, concepts: DataFrame, k: int = 1000, gap: int = 100, least: float = 0.005) -> DataFrame:
    """(row_id, col_id, value): explicit-semantic-analysis vectors: nearest concepts, cut where ``gap`` ranks gain little."""
    from .similarity import dots

    s = dots(vectors, concepts).select(F.col("a").alias("row_id"), F.col("b").alias("col_id"), F.col("dot").alias("score"))
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), "col_id")
    r = top(s, k, [F.desc("score"), F.asc("col_id")], ["row_id"]).withColumn("ahead", F.lead("score", gap).over(w)).withColumn("best", F.max("score").over(Window.partitionBy("row_id")))
    flat = F.col("ahead").isNotNull() & (F.col("score") - F.col("ahead") < least * F.col("best"))
    end = F.min(F.when(flat, F.col("rank"))).over(Window.partitionBy("row_id"))
    kept = r.withColumn("end", end).where("end is null or rank <= end")
    n = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("row_id")))
    return kept.select("row_id", "col_id", (F.col("score") / n).alias("value"))


def top_sense(resolved: DataFrame) -> DataFrame:
    return resolved.where("rank = 1").select("phrase", "page_id", "prob")


def consensus(*resolved: DataFrame) -> DataFrame:
    """(phrase, rank, page_id, prob): probabilities of several analysers summed."""
    every = resolved[0]
    for r in resolved[1:]:
        every = every.unionByName(r)
    s = every.groupBy("phrase", "page_id").agg(F.sum("prob").alias("prob"))
    return top(s, 10, [F.desc(F.round("prob", 9)), F.asc("page_id")], ["phrase"]).select("phrase", "rank", "page_id", "prob")


def by_similarity(candidates: DataFrame, scores: DataFrame, criterion: str = "sum") -> DataFrame:
    """(ctx, phrase, page_id, prob): senses of the phrases of a context, by relatedness to all its candidates.

    ``candidates`` has (ctx, phrase, page_id, prob), at most five of each phrase; ``scores`` (a, b, score). Relatedness
    is the sum of positive scores plus 1e-4, as a share of its phrase; criteria are sum, product, popularity, similarity.
    """
    c = top(candidates, 5, [F.desc("prob"), F.asc("page_id")], ["ctx", "phrase"]).drop("rank")
    a, b = c.select("ctx", "phrase", F.col("page_id").alias("a")), c.select("ctx", F.col("page_id").alias("b")).distinct()
    rel = a.join(b, "ctx").join(scores, ["a", "b"]).groupBy("ctx", "phrase", "a").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("rel"))
    j = c.join(rel.withColumnRenamed("a", "page_id"), ["ctx", "phrase", "page_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)) + 1e-4)
    w = Window.partitionBy("ctx", "phrase")
    sim = F.col("rel") / F.sum("rel").over(w)
    raw = {"sum": F.col("prob") + sim, "product": F.col("prob") * sim, "popularity": F.col("prob"), "similarity": sim}[criterion]
    return j.withColumn("raw", raw).withColumn("prob", F.col("raw") / F.sum("raw").over(w)).select("ctx", "phrase", "page_id", "prob")


def milne_witten_senses(scored: DataFrame, share: float = 0.4) -> DataFrame:
    """(ctx, phrase, page_id): of senses (ctx, phrase, page_id, sim, prob) near the best similarity the most popular."""
    w = Window.partitionBy("ctx", "phrase")
    near = scored.withColumn("most", F.max("sim").over(w)).where(F.col("sim") >= share * F.col("most"))
    return top(near, 1, [F.desc("prob"), F.asc("page_id")], ["ctx", "phrase"]).select("ctx", "phrase", "page_id")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n, docs)"""
    t = docs.select("doc_id", F.explode(T.tokens(F.lower(F.col(text_col)))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def bigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select(F.explode(T.ngrams(T.tokens(F.lower(F.col(text_col))), 2, 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def phrase_scores(docs: DataFrame, min_count: int = 5, text_col: str = "text") -> DataFrame:
    """(first, second, n, score): (n_ab - min_count) * N / (n_a * n_b) for pairs of following words."""
    toks = docs.select(T.tokens(F.lower(F.col(text_col))).alias("t"))
    uni = toks.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = uni.agg(F.sum("n").alias("total"))
    pair = toks.where(F.size("t") > 1).select(F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))
    pair = pair.where(F.col("n") >= min_count)
    j = pair.join(uni.select(F.col("w").alias("first"), F.col("n").alias("na")), "first").join(uni.select(F.col("w").alias("second"), F.col("n").alias("nb")), "second")
    return j.join(F.broadcast(total)).select("first", "second", "n", ((F.col("n") - min_count) * F.col("total") / (F.col("na") * F.col("nb"))).alias("score"))


def split_variants(phrase: Column) -> Column:
    """The heads and tails of three letters or more of a word of more than three, which a search for its parts takes; none for other phrases."""
    n = F.char_length(phrase)
    cuts = F.sequence(F.lit(1), n - 1)
    heads = F.transform(F.filter(cuts, lambda i: i > 2), lambda i: phrase.substr(F.lit(1), i))
    tails = F.transform(F.filter(cuts, lambda i: n - i > 2), lambda i: phrase.substr(i + 1, n))
    return F.when((n > 3) & ~F.contains(phrase, F.lit(" ")), F.concat(heads, tails)).otherwise(F.array().cast("array<string>"))


def fields_index(docs: DataFrame, fields: dict[str, tuple[str, int]], id_col: str = "doc_id") -> DataFrame:
    """(field, doc_id, term, tf): an index of several fields; ``fields`` names each one's column and how often it counts."""
    out = None
    for name, (column, times) in fields.items():
        part = term_index(docs, id_col, column).select(F.lit(name).alias("field"), "doc_id", "term", (F.col("tf") * times).alias("tf"))
        out = part if out is None else out.unionByName(part)
    return out


def text_senses(phrases: DataFrame, index: DataFrame, n_docs: int, k: int = 10, depth: int = 3) -> DataFrame:
    """(phrase, page_id, prob): pages whose title fits a phrase; failing that, whose text does; failing that, that hold parts of the word.

    ``index`` is one of fields "title" and "text". Scores are shares of the ``depth`` * k best, of which k are given.
    """
    named = phrases.select("phrase").distinct()
    words = named.select("phrase", F.explode(T.tokens(F.lower("phrase"))).alias("term"))
    parts = named.select("phrase", F.explode(split_variants(F.lower("phrase"))).alias("term"))
    title, text = (index.where(F.col("field") == f).drop("field") for f in ("title", "text"))

    def asked(q: DataFrame, ix: DataFrame, most: int) -> DataFrame:
        got = search(ix, q.select(F.col("phrase").alias("query_id"), "term"), n_docs, most)
        return got.select(F.col("query_id").alias("phrase"), F.col("doc_id").alias("page_id"), (F.col("score") / F.sum("score").over(Window.partitionBy("query_id"))).alias("prob"))

    found = cascade(asked(words, title, depth * k), asked(words, text, depth * k), asked(parts, text, 10))
    return top(found, k, [F.desc(F.round("prob", 9)), F.asc("page_id")], ["phrase"]).select("phrase", "page_id", "prob")


def pair_similarity(pairs: DataFrame, senses: DataFrame, scores: DataFrame, counts: DataFrame | None = None, share: float = 0.4) -> DataFrame:
    """(phrase1, phrase2, score): of all pairs of senses near the best score the most popular; compounds gain ln(n + 1) / 10.

    ``senses`` has (phrase, page_id, prob), at most 100 of each phrase; ``scores`` (a, b, score), a missing one is 0; ``counts``
    (phrase, n) tells how often the two phrases stand side by side, in either order. Phrases without senses go.
    """
    s = top(senses, 100, [F.desc("prob"), F.asc("page_id")], ["phrase"])
    j = pairs.select("phrase1", "phrase2").distinct()
    for i, p in (("1", "a"), ("2", "b")):
        j = j.join(s.select(F.col("phrase").alias(f"phrase{i}"), F.col("page_id").alias(p), F.col("prob").alias(f"prob{i}")), f"phrase{i}")
    j = j.join(scores, ["a", "b"], "left").withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
    most = F.max("score").over(Window.partitionBy("phrase1", "phrase2"))
    near = j.withColumn("most", most).where(F.col("score") >= share * F.col("most"))
    best = near.groupBy("phrase1", "phrase2").agg(F.max_by("score", F.struct(F.round(F.col("prob1") * F.col("prob2"), 12), "score")).alias("score"))
    if counts is None:
        return best
    n = counts.groupBy("phrase").agg(F.sum("n").alias("n"))
    for i, (x, y) in enumerate((("phrase1", "phrase2"), ("phrase2", "phrase1"))):
        best = best.withColumn("both", F.concat_ws(" ", x, y)).join(n.select(F.col("phrase").alias("both"), F.col("n").alias(f"n{i}")), "both", "left").drop("both")
    beside = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
    return best.select("phrase1", "phrase2", (F.col("score") + F.when(beside > 0, F.log(beside + 1.0) / 10).otherwise(0.0)).alias("score"))


def disambiguate(asked: DataFrame, senses: DataFrame, scores: DataFrame, criterion: str = "sum") -> DataFrame:
    """(ctx, phrase, page_id, prob) for a batch of contexts at once, from (ctx, phrase) and (phrase, page_id, prob)."""
    return by_similarity(asked.select("ctx", "phrase").distinct().join(senses.select("phrase", "page_id", "prob"), "phrase"), scores, criterion)


def disambiguated_top(asked: DataFrame, senses: DataFrame, scores: DataFrame, criterion: str = "sum") -> DataFrame:
    """(ctx, phrase, page_id): the best sense of each phrase of each context."""
    d = disambiguate(asked, senses, scores, criterion)
    return top(d, 1, [F.desc(F.round("prob", 9)), F.asc("page_id")], ["ctx", "phrase"]).select("ctx", "phrase", "page_id")
