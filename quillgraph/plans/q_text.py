"""Queries over phrases, texts, markup and entity links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stem, wikitext
from ..functions import text as T
from ..operators import esa, filters, models, phrases, wikify
from ..session import table
from . import bind as B
from .bind import r
from .catalogue import query

# anchors: the words of a part's name and type, in either case, name the part's brand (a page of its own)
ANCHORS = "anchors AS MATERIALIZED (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS anchor, (substr(p_brand, 7))::BIGINT AS page_id FROM part)"
COUNTS = f"{ANCHORS}, c AS MATERIALIZED (SELECT trim(lower(regexp_replace(anchor, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS phrase, page_id, count(*) AS count FROM anchors WHERE trim(regexp_replace(anchor, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) <> '' GROUP BY ALL)"


def anchors(spark, d):
    return table(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("anchor"), F.substring("p_brand", 7, 9).cast("long").alias("page_id"))


def _counts(spark, d):
    return phrases.counts(anchors(spark, d))


@query(f"WITH {COUNTS} SELECT * FROM c")
def phrase_counts(spark, d):
    return _counts(spark, d)


@query(f"""WITH {COUNTS} SELECT phrase, row_number() OVER w::INTEGER AS rank, page_id, round(count / sum(count) OVER (PARTITION BY phrase), 6)::DOUBLE AS prob FROM c WINDOW w AS (PARTITION BY phrase ORDER BY count DESC, page_id) QUALIFY row_number() OVER w <= 10""")
def phrase_senses(spark, d):
    return phrases.resolve(_counts(spark, d), 10).withColumn("prob", F.round("prob", 6))


@query(f"""WITH {COUNTS} SELECT page_id, row_number() OVER w::INTEGER AS rank, phrase, round(count / sum(count) OVER (PARTITION BY page_id), 6)::DOUBLE AS prob FROM c WINDOW w AS (PARTITION BY page_id ORDER BY count DESC, phrase) QUALIFY row_number() OVER w <= 5""")
def page_phrases(spark, d):
    return phrases.describe(_counts(spark, d), 5).withColumn("prob", F.round("prob", 6))


@query(f"""WITH {COUNTS}, w AS (SELECT *, sum(count) OVER (PARTITION BY phrase)::BIGINT AS total, row_number() OVER (PARTITION BY phrase ORDER BY count DESC, page_id)::INTEGER AS rank FROM c) SELECT phrase, page_id, count, total, rank FROM w WHERE count >= 3 AND count::DOUBLE / total >= 0.02 AND rank <= 8""")
def pruned_phrases(spark, d):
    return phrases.prune(_counts(spark, d), "phrase", "page_id", min_count=3, max_rank=8, min_share=0.02)


@query("""WITH s AS (SELECT p_size::BIGINT AS page_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 3 = 1 THEN p_brand || '!' ELSE p_brand END AS surface FROM part), c AS (SELECT page_id, surface, count(*) AS count FROM s GROUP BY ALL),
m AS (SELECT page_id, trim(lower(regexp_replace(surface, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS norm, arg_max(surface, (count, surface)) AS surface, sum(count)::BIGINT AS count FROM c GROUP BY page_id, norm)
SELECT page_id, surface, count, sum(count) OVER (PARTITION BY page_id)::BIGINT AS total, row_number() OVER (PARTITION BY page_id ORDER BY count DESC, surface)::INTEGER AS rank FROM m QUALIFY rank <= 4""")
def pruned_surfaces(spark, d):
    """Spellings with one normal form merged under the most frequent."""
    k = F.col("p_partkey") % 3
    s = table(spark, d, "part").select(F.col("p_size").cast("long").alias("page_id"), F.when(k == 0, F.upper("p_brand")).when(k == 1, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")).alias("surface"))
    return phrases.prune_normalised(s.groupBy("page_id", "surface").agg(F.count("*").alias("count")), "page_id", "surface", max_rank=4)


@query(f"""WITH {COUNTS}, t AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS phrase, min(p_partkey) AS page_id FROM part GROUP BY lower(split_part(p_type, ' ', 1))), s AS (SELECT phrase, page_id, (count / sum(count) OVER (PARTITION BY phrase))::DOUBLE AS prob, row_number() OVER (PARTITION BY phrase ORDER BY count DESC, page_id) AS k FROM c)
SELECT phrase, page_id, 1.0::DOUBLE AS prob FROM t UNION ALL SELECT phrase, page_id, round(prob, 6) FROM s WHERE k <= 10 AND phrase NOT IN (SELECT phrase FROM t)""")
def cascading_senses(spark, d):
    """Titles first, anchors for phrases that no title has."""
    t = table(spark, d, "part").groupBy(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("phrase")).agg(F.min("p_partkey").alias("page_id")).withColumn("prob", F.lit(1.0))
    return phrases.cascade(t, phrases.resolve(_counts(spark, d)).select("phrase", "page_id", F.round("prob", 6).alias("prob")))


@query(f"""WITH {COUNTS}, s AS (SELECT phrase, page_id, count::DOUBLE / sum(count) OVER (PARTITION BY phrase) AS prob, row_number() OVER (PARTITION BY phrase ORDER BY count DESC, page_id) AS k FROM c), u AS (SELECT phrase, page_id, prob FROM s WHERE k <= 10 UNION ALL SELECT phrase, page_id, prob FROM s WHERE k = 1),
m AS (SELECT phrase, page_id, sum(prob) AS prob FROM u GROUP BY ALL) SELECT phrase, row_number() OVER w::INTEGER AS rank, page_id, round(prob, 6) AS prob FROM m WINDOW w AS (PARTITION BY phrase ORDER BY round(prob, 9) DESC, page_id) QUALIFY row_number() OVER w <= 10""")
def consensus_senses(spark, d):
    s = phrases.resolve(_counts(spark, d)).select("phrase", "page_id", "prob", "rank")
    return phrases.consensus(s.drop("rank"), s.where("rank = 1").drop("rank")).withColumn("prob", F.round("prob", 6))


# texts -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {B.TOKENS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL")
def word_counts(spark, d):
    return phrases.word_counts(B.docs(spark, d))


PAIRS = f"{B.TOKENS}, pr AS MATERIALIZED (SELECT t[i] AS first, t[i + 1] AS second FROM (SELECT t, unnest(range(1, len(t))) AS i FROM toks))"


@query(f"WITH {PAIRS} SELECT first || ' ' || second AS bigram, count(*) AS n FROM pr GROUP BY ALL")
def bigram_counts(spark, d):
    return phrases.bigram_counts(B.docs(spark, d))


@query(f"""WITH {PAIRS}, u AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM toks) GROUP BY ALL), p AS (SELECT first, second, count(*) AS n FROM pr GROUP BY ALL HAVING count(*) >= 5)
SELECT first, second, p.n, round((p.n - 5) * (SELECT sum(n) FROM u)::DOUBLE / (a.n * b.n), 6) AS score FROM p JOIN u a ON a.w = first JOIN u b ON b.w = second""")
def phrase_scores(spark, d):
    return phrases.phrase_scores(B.docs(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {B.TOKENS} SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct, coalesce(t[1], '') AS first_token FROM toks")
def token_stats(spark, d):
    t = B.docs(spark, d).select("doc_id", T.tokens(F.lower("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


@query(f"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{B.TOKEN}') AS t FROM benchmark), k AS (SELECT phrase, count(*) AS n_links FROM (SELECT t[i] || ' ' || t[i + 1] AS phrase FROM (SELECT t, unnest(range(1, len(t))) AS i FROM b)) GROUP BY ALL),
{B.TOKENS}, g AS (SELECT list_extract(t, i) || ' ' || list_extract(t, i + 1) AS phrase FROM (SELECT t, unnest(range(1, len(t))) AS i FROM toks)), s AS (SELECT phrase, count(*) AS n FROM g GROUP BY ALL)
SELECT phrase, n_links, coalesce(n, 0) AS n_seen, round(n_links::DOUBLE / (coalesce(n, 0) + 3), 6) AS prob FROM k LEFT JOIN s USING (phrase)""")
def link_probability(spark, d):
    """How often known phrases are links, from all places where they occur."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    known = phrases.bigram_counts(b).select(F.col("bigram").alias("phrase"), F.col("n").alias("n_links"))
    return phrases.link_probability(B.docs(spark, d), known, 3).withColumn("prob", F.round("prob", 6))


INDEX = f"{B.TOKENS}, ix AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL), df AS MATERIALIZED (SELECT term, count(*) AS df FROM ix GROUP BY ALL), nd AS (SELECT count(*)::DOUBLE AS n FROM documents)"


@query(f"""WITH {INDEX}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{B.TOKEN}')) AS term FROM benchmark), sz AS (SELECT doc_id, sum(tf)::DOUBLE AS size FROM ix GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(sqrt(tf::DOUBLE) * (1 + ln(n / (df + 1))) ^ 2 / sqrt(size)) AS score FROM q JOIN df USING (term) JOIN ix USING (term) JOIN sz USING (doc_id) CROSS JOIN nd GROUP BY ALL)
SELECT query_id, row_number() OVER w::INTEGER AS rank, doc_id, round(score, 5) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) QUALIFY row_number() OVER w <= 10""")
def text_search(spark, d):
    """The ten documents that fit each benchmark text best."""
    docs = B.docs(spark, d)
    q = phrases.term_index(table(spark, d, "benchmark"), "item_id").select(F.col("doc_id").alias("query_id"), "term")
    return phrases.search(phrases.term_index(docs), q, docs.count(), 10).withColumn("score", F.round("score", 5))


@query(f"""WITH {INDEX}, v AS (SELECT doc_id, term, tf * ln(n / df) AS v FROM ix JOIN df USING (term) CROSS JOIN nd WHERE df >= 5 AND df <= 0.5 * n AND tf * ln(n / df) > 0), z AS (SELECT doc_id, sqrt(sum(v * v)) AS z FROM v GROUP BY ALL)
SELECT doc_id AS row_id, term AS col_id, round(v / z, 6) AS value FROM v JOIN z USING (doc_id)""")
def tf_idf_vectors(spark, d):
    docs = B.docs(spark, d)
    return phrases.tf_idf(phrases.term_index(docs), docs.count(), 5, 0.5).withColumn("value", F.round("value", 6))


@query(f"""WITH {INDEX}, dq AS (SELECT term, df, ln(n / (df + 1)) + 1 AS idf FROM df, nd WHERE df >= 2 AND df <= 0.05::DOUBLE * n), bx AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{B.TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
q AS (SELECT item_id, term, tf * idf AS w, idf FROM bx JOIN dq USING (term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tf * idf DESC, term) <= 20), sz AS (SELECT doc_id, sum(tf)::DOUBLE AS size FROM ix GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(sqrt(tf::DOUBLE) * idf * w / sqrt(size)) AS score FROM q JOIN ix USING (term) JOIN sz USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS rank, lead(score, 100) OVER o AS ahead, max(score) OVER (PARTITION BY item_id) AS best FROM s WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 1000),
e AS (SELECT *, min(CASE WHEN ahead IS NOT NULL AND score - ahead < 0.005 * best THEN rank END) OVER (PARTITION BY item_id) AS stop FROM r), k AS (SELECT * FROM e WHERE stop IS NULL OR rank <= stop)
SELECT item_id AS row_id, doc_id AS col_id, round(score / sqrt(sum(score * score) OVER (PARTITION BY item_id)), 6) AS value FROM k""")
def text_concepts(spark, d):
    """Benchmark texts as vectors of the documents that their terms hit."""
    docs = B.docs(spark, d)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return esa.text_vectors(b, phrases.term_index(docs), docs.count(), min_tf=1, min_df=2).withColumn("value", F.round("value", 6))


@query(f"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{B.TOKEN}')) - len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{B.TOKEN}'), lambda x: list_contains({T.STOP['en']}, x))) AS n FROM documents WHERE lang = 'en'""")
def content_words(spark, d):
    """English texts without their stop words."""
    e = B.docs(spark, d).where("lang = 'en'")
    return e.select("doc_id", F.size(stem.analyse(F.col("text"), "en", stems=False)).cast("long").alias("n"))


def _stems_sql() -> str:
    stops = " OR ".join(f"(lang = '{lang}' AND list_contains({T.STOP[lang]}, w))" for lang in ("en", "de", "fr", "es"))
    ends = " ".join(f"WHEN lang = '{lang}' THEN regexp_replace(w, '^(.*?\\p{{L}}{{3}})(?:{'|'.join(stem.ENDINGS[lang])})$', '\\1')" for lang in ("de", "fr", "es"))
    return f"""WITH {B.TOKENS}, x AS (SELECT lang, unnest(t) AS w FROM toks WHERE lang IN ('en', 'de', 'fr', 'es')), k AS (SELECT * FROM x WHERE NOT ({stops})),
a AS (SELECT lang, w, CASE WHEN lang <> 'en' THEN w WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%ies' THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END AS t FROM k), b AS (SELECT *, regexp_replace(t, '(ed|ing)$', '') AS c FROM a),
e AS (SELECT *, CASE WHEN lang = 'en' AND c <> t AND regexp_matches(c, '[aeiouy]') THEN CASE WHEN regexp_matches(c, '(at|bl|iz)$') THEN c || 'e' WHEN length(c) > 1 AND c[-1] = c[-2:-2] AND NOT contains('aeiouylsz', c[-1]) THEN c[:-2] ELSE c END ELSE t END AS d FROM b)
SELECT lang, CASE WHEN lang = 'en' THEN CASE WHEN regexp_matches(d, '[aeiouy].*y$') THEN d[:-2] || 'i' ELSE d END {ends} END AS term, count(*) AS n FROM e GROUP BY ALL"""


@query(_stems_sql())
def stemmed_terms(spark, d):
    """Terms of each language after stop words and stems."""
    out = None
    for lang in ("en", "de", "fr", "es"):
        t = B.docs(spark, d).where(F.col("lang") == lang).select(F.lit(lang).alias("lang"), F.explode(stem.analyse(F.col("text"), lang)).alias("term"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("lang", "term").agg(F.count("*").alias("n"))


@query()
def sentence_counts(spark, d):
    """Sentences and words as a break iterator finds them, and n-grams of two to three words of all sentences."""
    s = B.docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.size(F.flatten("s")).alias("n_words"), F.size(F.flatten(F.transform("s", lambda x: T.ngrams(x, 2, 3)))).alias("n_grams"))


@query("""SELECT p_partkey AS page_id, upper(substr(p_brand, 1, 1)) || substr(p_brand, 2) || ' and ' || p_name AS title, '/w/en/' || p_partkey::VARCHAR || '/' || replace(p_name, ' ', '_') AS url, p_name AS back FROM part""")
def titles_and_urls(spark, d):
    """Titles brought to their canonical form, and the round trip through a compact URL."""
    p = table(spark, d, "part")
    raw = F.concat(F.lit("_"), F.lower(F.substring("p_brand", 1, 1)), F.substring("p_brand", 2, 99), F.lit("_and "), F.regexp_replace("p_name", " ", "_"), F.lit("_#Section_1"))
    url = T.page_url(F.lit("en"), F.col("p_partkey"), F.col("p_name"))
    # the sharp sign of brands would start an anchor
    title = F.replace(T.canonical_title(F.replace(raw, F.lit("#"), F.lit("\u0001"))), F.lit("\u0001"), F.lit("#"))
    return p.select("p_partkey", "p_name", title.alias("t"), url.alias("url")).select(F.col("p_partkey").alias("page_id"), F.regexp_replace("t", " #Section 1$", "").alias("title"), "url", T.url_parts(F.col("url"))["title"].alias("back"))


@query("""SELECT doc_id, lower(source) LIKE 'list%' OR regexp_matches(source, '^[0-9]+$') AS blacklisted, length(n) AS n_chars, md5(n) AS normal FROM (SELECT doc_id, source, trim(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS n FROM documents)""")
def normal_forms(spark, d):
    """Normal forms of whole texts, by length and digest."""
    x = table(spark, d, "documents")
    n = x.select("doc_id", "source", T.normalise(F.coalesce("text", F.lit(""))).alias("n"))
    return n.select("doc_id", filters.is_blacklisted(F.col("source")).alias("blacklisted"), F.char_length("n").cast("long").alias("n_chars"), F.md5("n").alias("normal"))


# markup ------------------------------------------------------------------------------------------------------------------


def _markup(spark, d):
    p = table(spark, d, "part")
    body = F.concat(
        F.lit("'''"), F.col("p_name"), F.lit("''' is made by [["), F.col("p_brand"), F.lit("|its maker]] {{box|[[In box]]}}\n\nSee [[File:a.png|thumb|of [["), F.split_part("p_type", F.lit(" "), F.lit(1)),
        F.lit("]]]].\n\n== See also ==\n* [["), F.split_part("p_type", F.lit(" "), F.lit(2)), F.lit("]]\n\n[[Category:size "), F.col("p_size").cast("string"), F.lit("]] [[de:"), F.col("p_name"), F.lit("]]"),
    )
    redirect = F.concat(F.lit("#REDIRECT [["), F.col("p_brand"), F.lit("]]"))
    return p.select(F.lit(1).alias("lang_id"), F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 9 == 0, redirect).otherwise(body).alias("body"))


@query("""WITH p AS (SELECT *, p_partkey % 9 = 0 AS red FROM part) SELECT p_partkey AS page_id, 'redirect' AS kind, split_part(p_brand, '#', 1) AS target, NULL AS anchor FROM p WHERE red UNION ALL
SELECT p_partkey, 'link', split_part(p_brand, '#', 1), 'its maker' FROM p WHERE NOT red UNION ALL SELECT p_partkey, 'link', 'In box', 'In box' FROM p WHERE NOT red UNION ALL
SELECT p_partkey, 'link', split_part(p_type, ' ', 1), split_part(p_type, ' ', 1) FROM p WHERE NOT red UNION ALL SELECT p_partkey, 'seealso', split_part(p_type, ' ', 2), split_part(p_type, ' ', 2) FROM p WHERE NOT red AND split_part(p_type, ' ', 2) <> '' UNION ALL
SELECT p_partkey, 'category', 'size ' || p_size::VARCHAR, NULL FROM p WHERE NOT red UNION ALL SELECT p_partkey, 'language', 'de:' || p_name, NULL FROM p WHERE NOT red""")
def markup_links(spark, d):
    """Links, categories, languages and redirects of pages in wiki markup."""
    p = wikitext.parse(_markup(spark, d))
    return p.select("page_id", "kind", "target", "anchor")


@query("SELECT p_partkey AS page_id, p_name || ' is made by its maker' AS text FROM part")
def markup_text(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("'''"), F.col("p_name"), F.lit("''' is made{{note|x {{y}}}} by [["), F.col("p_brand"), F.lit("|its maker]]<ref>r</ref>")).alias("body"))
    return m.select("page_id", T.strip_markup(F.col("body")).alias("text"))


# entity links --------------------------------------------------------------------------------------------------------------


def _known(spark, d):
    """Phrases of one to three words with their link probability, all their senses with priors and relatedness of pages, from the benchmark's texts."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    ix = b.select("doc_id", F.explode(T.ngrams(T.tokens(F.lower("text")), 1, 3)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    known = phrases.link_probability(B.docs(spark, d), ix.groupBy(F.col("term").alias("phrase")).agg(F.sum("tf").alias("n_links")), 3).select("phrase", "prob")
    senses = phrases.prune(ix.select(F.col("term").alias("phrase"), F.col("doc_id").alias("page_id"), F.col("tf").alias("count")), "phrase", "page_id").select("phrase", "page_id", (F.col("count") / F.col("total")).alias("prob"))
    from ..operators.similarity import cosine

    v = ix.select(F.col("doc_id").alias("row_id"), F.xxhash64("term").alias("col_id"), F.col("tf").cast("double").alias("value"))
    return known, senses, cosine(v)


def _degrees(senses):
    return senses.groupBy("page_id").agg(F.count("*").alias("in_degree"))


@query()
def wikify_documents(spark, d):
    """Spans of every document linked to pages."""
    known, senses, scores = _known(spark, d)
    return wikify.milne_witten(B.docs(spark, d), known, senses, scores, _degrees(senses), longest=3, least=0.001, final=1e-6).withColumn("score", F.round("score", 9))


@query()
def wikify_combined(spark, d):
    known, senses, scores = _known(spark, d)
    return wikify.combined(B.docs(spark, d), known, senses, scores, longest=3, least=0.001, final=1e-9).withColumn("score", F.round("score", 9))


@query()
def phrase_tokens(spark, d):
    """Documents cut into known phrases and single words."""
    known, _, _ = _known(spark, d)
    return wikify.phrase_tokens(B.docs(spark, d), known, 3).groupBy("token").agg(F.count("*").alias("n"))


@query()
def learnt_phrases(spark, d):
    """Phrases of up to four words, with a threshold learnt from the benchmark's."""
    b = phrases.bigram_counts(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("bigram").alias("phrase"))
    return models.learn_phrases(B.docs(spark, d), b).withColumn("score", F.round("score", 6))


@query()
def word_vectors(spark, d):
    """Skip-gram vectors of the conversations' words, of length 1 each."""
    s = table(spark, d, "conversations").select(T.tokens(F.lower("text")).alias("words"))
    return models.skip_gram(s, size=32, min_count=3, rounds=1).select("word", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))
