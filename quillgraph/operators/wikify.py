"""Entity linking: which spans of a text name which pages, by joins for candidates and scores and a greedy choice of spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import cut
from .phrases import look_up

SPAN = "array<struct<begin:int,end:int,score:double,page_id:long>>"


def spans(docs: DataFrame, known: DataFrame, longest: int = 3, least: float = 0.03) -> DataFrame:
    """(doc_id, begin, end, phrase, link_prob): n-grams of up to ``longest`` words whose link probability is enough.

    Positions are of words. Every n-gram is looked up by a join, so that phrases need not fit anywhere.
    """
    toks = docs.select("doc_id", T.tokens(F.lower("text")).alias("t"))
    parts = None
    for n in range(1, longest + 1):
        g = toks.select("doc_id", F.posexplode(T.ngrams(F.col("t"), n, n)).alias("begin", "phrase")).select("doc_id", "begin", (F.col("begin") + n).alias("end"), "phrase")
        parts = g if parts is None else parts.unionByName(g)
    return look_up(parts, known.where(F.col("prob") >= least).select("phrase", F.col("prob").alias("link_prob"))).select("doc_id", "begin", "end", "phrase", "link_prob")


def greedy(scored: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, begin, end, page_id, score): the best span first, then the best that doesn't overlap those taken.

    Ties go to the earlier, then the longer span, then the smaller page. One document's spans are an array, which is
    sorted in the JVM; the walk over it needs state and is the only step in Python.
    """
    per = scored.groupBy("doc_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "begin", (-F.col("end")).alias("e"), F.col("page_id").cast("long").alias("page_id"))).alias("x"))
    per = per.select("doc_id", F.transform(F.array_sort("x"), lambda x: F.struct(x["begin"].alias("begin"), (-x["e"]).alias("end"), (-x["s"]).alias("score"), x["page_id"].alias("page_id"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, begins, ends, scores, pages = [], [], [], [], []
            for d, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                used: set[int] = set()
                taken = 0
                for x in xs:
                    if most is not None and taken >= most:
                        break
                    words = range(x["begin"], x["end"])
                    if used.isdisjoint(words):
                        used.update(words)
                        taken += 1
                        docs.append(d)
                        begins.append(x["begin"])
                        ends.append(x["end"])
                        scores.append(x["score"])
                        pages.append(x["page_id"])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(pages, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "begin", "end", "page_id", "score"])

    return per.select(F.col("doc_id").cast("long"), "x").mapInArrow(run, "doc_id long, begin int, end int, page_id long, score double")


def phrase_tokens(docs: DataFrame, known: DataFrame, longest: int = 3, least: float = 1e-5) -> DataFrame:
    """(doc_id, begin, end, token): known phrases, likeliest first, that don't overlap; what is left as single words."""
    s = spans(docs, known, longest, least)
    chosen = greedy(s.select("doc_id", "begin", "end", F.lit(0).alias("page_id"), F.col("link_prob").alias("score"))).select("doc_id", "begin", "end")
    # a document's words stay a list: only the chosen phrases are joined to it, and what is left is told from them
    per = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("x"))
    j = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.tokens(F.lower("text")).alias("t")).join(per, "doc_id", "left")
    inner = F.flatten(F.transform("x", lambda s: F.sequence(s["begin"], s["end"] - 1)))
    alone = F.array_except(F.sequence(F.lit(0), F.size("t") - 1), F.coalesce(inner, F.array().cast("array<int>")))
    single = F.transform(alone, lambda i: F.struct(i.alias("begin"), (i + 1).alias("end")))
    cuts = F.concat(F.coalesce("x", F.array().cast("array<struct<begin:int,end:int>>")), single)
    token = lambda s: F.array_join(F.slice("t", s["begin"] + 1, s["end"] - s["begin"]), " ")
    told = F.transform(cuts, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), token(s).alias("token")))
    return j.where(F.size("t") > 0).select("doc_id", F.explode(told).alias("s")).select("doc_id", "s.begin", "s.end", "s.token")


def generality(in_links: Column) -> Column:
    return 0.5 + F.log(1 + F.least(F.lit(1000.0), in_links.cast("double"))) / F.log(F.lit(1001.0))


def _senses(s: DataFrame, senses: DataFrame) -> DataFrame:
    return s.join(senses.select("phrase", "page_id", F.col("prob").alias("prior")), "phrase")


def _relatedness(cand: DataFrame, scores: DataFrame) -> DataFrame:
    """Each candidate's mean relatedness to the document's other candidates, weighted by their prior and link probability."""
    c = cand.groupBy("doc_id", "page_id").agg(F.max(F.col("prior") * F.col("link_prob")).alias("w"))
    a, b = c.select("doc_id", F.col("page_id").alias("a")), c.select("doc_id", F.col("page_id").alias("b"), "w")
    # via the score table: only pairs of pages that have a score meet
    r = a.join(scores, "a").join(b, ["doc_id", "b"]).groupBy("doc_id", "a").agg(F.sum(F.col("score") * F.col("w")).alias("s"))
    total = c.groupBy("doc_id").agg(F.sum("w").alias("total"))
    out = r.join(total, "doc_id").select("doc_id", F.col("a").alias("page_id"), (F.col("s") / F.col("total")).alias("related"))
    return cand.join(out, ["doc_id", "page_id"], "left").withColumn("related", F.coalesce("related", F.lit(0.0)))


#: Pages whose relatedness is held as a matrix, at most, and senses.
_PAGES, _SENSES = 2048, 2_000_000


def _best_senses(docs: DataFrame, known: DataFrame, senses: DataFrame, scores: DataFrame, longest: int, least: float, weigh: str, factor: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """(doc_id, begin, end, page_id, raw, next): the best sense of each span by ``weigh``, an expression, and the score of the next.

    ``weigh`` has prior, link_prob, related, factor (of (page_id, factor), 1 by default) and has (1 for ``existing`` (doc_id, page_id)).
    Senses are told for a document's phrases, not for each of their places. Where pages are few, a document's candidates stand as
    a vector that a matrix of all scores multiplies; else they are rows.
    """
    s = cut(spans(docs, known, longest, least))
    senses = cut(senses.select("phrase", F.col("page_id").cast("long").alias("page_id"), F.col("prob").alias("prior")))
    asked = s.select("doc_id", "phrase", "link_prob").distinct()
    has = None if existing is None else existing.select("doc_id", F.col("page_id").cast("long").alias("page_id")).distinct()
    some = senses.select("page_id").distinct().limit(_PAGES + 1).collect()
    if len(some) <= _PAGES and senses.limit(_SENSES + 1).count() <= _SENSES:
        best = _by_matrix(asked, senses, scores, sorted(r[0] for r in some), weigh, factor, has)
    else:
        c = _relatedness(asked.join(senses, "phrase"), scores)
        c = c.withColumn("factor", F.lit(1.0)) if factor is None else c.join(factor, "page_id", "left").withColumn("factor", F.coalesce("factor", F.lit(0.5)))
        c = c.withColumn("has", F.lit(0)) if has is None else c.join(has.withColumn("has", F.lit(1)), ["doc_id", "page_id"], "left").withColumn("has", F.coalesce("has", F.lit(0)))
        c = c.withColumn("raw", F.expr(weigh))
        w = Window.partitionBy("doc_id", "phrase").orderBy(F.desc("raw"), "page_id")
        best = c.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("raw").over(w)).where("r = 1").select("doc_id", "phrase", "page_id", "raw", "next")
    return s.select("doc_id", "begin", "end", "phrase").join(best, ["doc_id", "phrase"]).select("doc_id", "begin", "end", "page_id", "raw", "next")


def _by_matrix(asked: DataFrame, senses: DataFrame, scores: DataFrame, pages: list[int], weigh: str, factor: DataFrame | None, has: DataFrame | None) -> DataFrame:
    """(doc_id, phrase, page_id, raw, next): _best_senses() where the pages are few, from a list of phrases for each document."""
    number = np.array(pages, np.int64)
    inside = scores.where(F.col("a").isin(pages) & F.col("b").isin(pages)).select("a", "b", "score").toArrow()  # _PAGES squared at most
    matrix = np.zeros((len(number), len(number)))
    a, b = (np.searchsorted(number, inside.column(c).to_numpy()) for c in ("a", "b"))
    np.add.at(matrix, (a, b), inside.column("score").to_numpy())
    factors = np.ones(len(number))
    if factor is not None:
        known = dict(factor.where(F.col("page_id").isin(pages)).collect())
        factors = np.array([known.get(p, 0.5) for p in pages])
    table = senses.orderBy("phrase", "page_id").toArrow()  # _SENSES at most
    where: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    names, ids, prior = table.column("phrase").to_pylist(), np.searchsorted(number, table.column("page_id").to_numpy()), table.column("prior").to_numpy()
    at = 0
    for k in range(1, len(names) + 1):
        if k == len(names) or names[k] != names[at]:
            where[names[at]], at = (ids[at:k], prior[at:k]), k
    shared = asked.sparkSession.sparkContext.broadcast((number, matrix, factors, where))
    code = compile(weigh, "weigh", "eval")
    per = asked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct("phrase", "link_prob")).alias("x"))
    if has is not None:
        per = per.join(has.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list("page_id").alias("has")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, matrix, factors, where = shared.value
        for batch in batches:
            out: list[tuple] = []
            linked = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for doc, xs, old in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), linked, strict=True):
                xs = [x for x in xs if x["phrase"] in where]
                if not xs:
                    continue
                w = np.zeros(len(number))
                for x in xs:
                    p, prior = where[x["phrase"]]
                    w[p] = np.maximum(w[p], prior * x["link_prob"])
                related = matrix @ w / (w.sum() or 1.0)
                mine = np.isin(number, old or [])
                for x in xs:
                    p, prior = where[x["phrase"]]
                    raw = eval(code, {"prior": prior, "link_prob": x["link_prob"], "related": related[p], "factor": factors[p], "has": mine[p]})
                    k = int(np.argmax(raw))  # pages are in order, so that ties go to the smaller
                    rest = np.delete(raw, k)
                    out.append((doc, x["phrase"], int(number[p[k]]), float(raw[k]), float(rest.max()) if len(rest) else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "phrase", "page_id", "raw", "next"])

    return per.mapInArrow(run, "doc_id long, phrase string, page_id long, raw double, next double")


def milne_witten(docs: DataFrame, known: DataFrame, senses: DataFrame, scores: DataFrame, in_links: DataFrame, longest: int = 3, least: float = 0.03, final: float = 0.01) -> DataFrame:
    """(doc_id, begin, end, page_id, score): prior * relatedness * link probability * generality, with a margin.

    A sense gains by the ratio to the next best of its span, 3 at most, and 3 where it is the only one; the best senses
    are chosen greedily, and scores below ``final`` go. ``in_links`` has (page_id, in_degree).
    """
    factor = in_links.select(F.col("page_id").cast("long").alias("page_id"), generality(F.coalesce("in_degree", F.lit(0))).alias("factor"))
    c = _best_senses(docs, known, senses, scores, longest, least, "prior * related * link_prob * factor", factor)
    margin = F.when(F.col("next").isNull() | (F.col("next") <= 0), 3.0).otherwise(F.least(F.lit(3.0), F.col("raw") / F.col("next")))
    return greedy(c.select("doc_id", "begin", "end", "page_id", (F.col("raw") * margin).alias("score")).where(F.col("score") >= final))


def combined(docs: DataFrame, known: DataFrame, senses: DataFrame, scores: DataFrame, existing: DataFrame | None = None, longest: int = 3, least: float = 0.01, final: float = 0.001) -> DataFrame:
    """(doc_id, begin, end, page_id, score): (0.4 * relatedness + 0.6 * prior) * link probability, + 0.2 for pages linked already.

    The margin to the next sense multiplies the score, 0.2 where there is none. ``existing`` has (doc_id, page_id).
    """
    c = _best_senses(docs, known, senses, scores, longest, least, "(0.4 * related + 0.6 * prior) * link_prob + 0.2 * has", existing=existing)
    margin = F.when(F.col("next").isNull(), 0.2).otherwise(F.col("raw") - F.col("next"))
    return greedy(c.select("doc_id", "begin", "end", "page_id", (F.col("raw") * margin).alias("score")).where(F.col("score") >= final))


def threshold(judged: DataFrame, score: str = "score", good: str = "good", steps: int = 100) -> float:
    """The score that gives the best F1 over judged links; scores go in ``steps`` bins, so the sums are a bounded table."""
    hi = judged.agg(F.max(score)).first()[0]
    if not hi:
        return 0.0
    h = judged.groupBy(F.least(F.floor(F.col(score) / hi * steps), F.lit(steps - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(good).cast("int")).alias("g")).orderBy(F.desc("bin")).collect()  # at most ``steps`` rows
    total, n, g, best = sum(r.g for r in h), 0, 0, (-1.0, 0.0)
    for r in h:
        n, g = n + r.n, g + r.g
        best = max(best, (2 * g / (n + total) if n + total else 0.0, r.bin / steps * hi))
    return best[1]


def identity(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page_id, anchor, begin, end): a text's own links aligned to it by offset of characters.

    Links (doc_id, location, anchor, page_id) are taken in order; each goes to the next place of its anchor after the
    one before, or, if there is none, to its first free place. Links without a place go.
    """
    per = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("location", "anchor", F.col("page_id").cast("long").alias("page_id")))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text, xs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                used: list[tuple[int, int]] = []
                at = 0
                for x in xs:
                    a = x["anchor"] or ""
                    for start in (at, 0):
                        i = text.find(a, start) if a and text else -1
                        while i >= 0 and any(i < e and s < i + len(a) for s, e in used):
                            i = text.find(a, i + 1)
                        if i >= 0:
                            break
                    if i >= 0:
                        used.append((i, i + len(a)))
                        at = max(at, i + len(a))
                        rows.append((d, x["page_id"], a, i, i + len(a)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "page_id", "anchor", "begin", "end"])

    j = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per, "doc_id")
    return j.select("doc_id", "text", "x").mapInArrow(run, "doc_id long, page_id long, anchor string, begin int, end int")


def corpus(docs: DataFrame, mentions: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc_id, line): the words of a text with the linked page's URL at each mention: word_word:/w/..."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(T.tokens(F.col("text"))).alias("i", "w"))
    m = mentions.join(urls.select("page_id", "url"), "page_id").select("doc_id", "begin", "end", "url")
    laid = m.select("doc_id", "begin", "url", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("i"))
    j = words.join(laid, ["doc_id", "i"], "left").withColumn("begin", F.coalesce("begin", "i"))
    t = j.groupBy("doc_id", "begin").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x"), F.first("url", ignorenulls=True).alias("url"))
    word = F.array_join(F.transform("x", lambda x: x["w"]), "_")
    t = t.select("doc_id", "begin", F.when(F.col("url").isNull(), word).otherwise(F.concat(word, F.lit(":"), F.col("url"))).alias("t"))
    return t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "t"))).alias("x")).select("doc_id", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("line"))


def universal_corpus(lines: DataFrame, concepts: DataFrame, lang: str) -> DataFrame:
    """(doc_id, line): a corpus line for several languages: words get the prefix of their language, mentions their page and concept.

    ``concepts`` has (url, univ_id).
    """
    t = lines.select("doc_id", F.posexplode(F.split("line", " ")).alias("i", "t")).withColumn("url", F.regexp_extract("t", r":(/w/.*)$", 1)).withColumn("word", F.regexp_replace("t", r":/w/.*$", ""))
    j = t.join(concepts.select("url", F.col("univ_id")), "url", "left")
    prefix = F.concat(F.lit(f"{lang}:"), F.col("word"))
    token = F.when(F.col("url") == "", prefix).otherwise(F.concat_ws(" ", prefix, "url", F.concat(F.lit("/c/"), F.col("univ_id").cast("string"))))
    return j.select("doc_id", "i", token.alias("t")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("x")).select("doc_id", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("line"))
