"""Phrases, markup, entity links, dumps."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stem, wikitext
from quillgraph.functions import text as T
from quillgraph.operators import esa, models, phrases, wikify
from quillgraph.sources import dumps, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_pruning(spark):
    c = spark.createDataFrame([("p", 999, 10), ("p", 31, 4), ("p", 3424, 1)], "phrase string, page_id long, count long")
    got = phrases.prune(c, "phrase", "page_id").orderBy("rank").collect()
    assert [(r.page_id, r.total) for r in got] == [(999, 15), (31, 15), (3424, 15)]
    for how in ({"min_count": 2}, {"max_rank": 2}, {"min_share": 0.1}):
        assert [r.page_id for r in phrases.prune(c, "phrase", "page_id", **how).orderBy("rank").collect()] == [999, 31]
    s = spark.createDataFrame([(1, "z", 3), (1, "wAz", 4), (1, "Z.", 8), (1, "Y", 9)], "page_id long, surface string, count long")
    assert {r.surface: (r["count"], r.total) for r in phrases.prune_normalised(s, "page_id", "surface").collect()} == {"Z.": (11, 24), "Y": (9, 24), "wAz": (4, 24)}


def test_text_functions(spark):
    assert one(spark, T.canonical_title(F.lit("foo_bar : baz#x"))) == "Foo bar:Baz"
    assert one(spark, T.title_name(F.lit("Mercury (planet)"))) == "Mercury" and one(spark, T.title_disambiguator(F.lit("Mercury (planet)"))) == "planet"
    assert one(spark, T.ngrams(T.tokens(F.lit("a b c")), 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, T.ngrams(T.tokens(F.lit("")), 1, 2)) == []
    assert one(spark, T.normalise(F.lit("  Fo-o!! Bär "))) == "fo o bär"
    assert one(spark, stem.analyse(F.lit("The ponies were running and hopped"), "en")) == ["poni", "run", "hop"]
    assert one(spark, stem.analyse(F.lit("日本語"), "ja")) == ["日本", "本語"]


def test_search_and_vectors(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red dog"), (3, "blue whale"), (4, "")], "doc_id long, text string")
    ix = phrases.term_index(docs)
    q = spark.createDataFrame([(1, "fox"), (1, "red")], "query_id long, term string")
    got = phrases.search(ix, q, 4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]
    idf = lambda df: 1 + math.log(4 / (df + 1))
    assert got[0].score == pytest.approx((math.sqrt(2) * idf(2) ** 2 + idf(1) ** 2) / math.sqrt(3))
    v = esa.text_vectors(docs, ix, 4, min_tf=1, min_df=1, max_share=1.0)
    n = {r.row_id: r.n for r in v.groupBy("row_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()}
    assert all(x == pytest.approx(1) for x in n.values()) and set(n) == {1, 2, 3}


def test_markup(spark):
    page = "Intro [[Foo bar|anchor]] {{main|Topic}}\n\nsecond [[:Category:Not one]] [[Category:Things|key]]\n\n== See also ==\n* [[Other#part]] {{box|[[Hidden]]}} [[fr:Autre]] <!-- [[no]] -->"
    raw = spark.createDataFrame([(1, 5, page), (1, 6, "#redirect [[Foo bar]]"), (1, 7, None)], "lang_id int, page_id long, body string")
    p = wikitext.parse(raw).cache()
    got = {(r.page_id, r.kind, r.target) for r in p.collect()}
    assert got == {(5, "link", "Foo bar"), (5, "main", "Topic"), (5, "link", "Category:Not one"), (5, "category", "Things"), (5, "seealso", "Other"), (5, "seealso", "Hidden"), (5, "language", "fr:Autre"), (6, "redirect", "Foo bar")}
    place = {r.dest_title: (r.location_type, r.is_parseable) for r in wikitext.links(p).collect()}
    assert place["Foo bar"] == (0, True) and place["Hidden"] == (2, False)
    assert rows(wikitext.redirects(p).select("src_page_id", "dest_title")) == [(6, "Foo bar")]
    assert rows(wikitext.languages(p).select("dest_lang", "dest_title")) == [("fr", "Autre")]


def test_greedy_spans(spark):
    s = spark.createDataFrame([(1, 0, 2, 10, 0.9), (1, 1, 3, 11, 0.8), (1, 2, 3, 12, 0.5), (1, 5, 6, 13, 0.1), (2, 0, 1, 14, 0.3)], "doc_id long, begin int, end int, page_id long, score double")
    assert [(r.doc_id, r.page_id) for r in wikify.greedy(s).orderBy("doc_id", "begin").collect()] == [(1, 10), (1, 12), (1, 13), (2, 14)]


def test_entity_links(spark):
    docs = spark.createDataFrame([(1, "The red planet and the god"), (2, "")], "doc_id long, text string")
    known = spark.createDataFrame([("red planet", 0.5), ("god", 0.4), ("planet", 0.2)], "phrase string, prob double")
    senses = spark.createDataFrame([("red planet", 1, 1.0), ("god", 2, 0.6), ("god", 3, 0.4), ("planet", 4, 1.0)], "phrase string, page_id long, prob double")
    scores = spark.createDataFrame([(1, 3, 0.9), (3, 1, 0.9), (1, 2, 0.1), (2, 1, 0.1)], "a long, b long, score double")
    deg = spark.createDataFrame([(1, 100), (2, 5), (3, 50)], "page_id long, in_degree long")
    got = wikify.milne_witten(docs, known, senses, scores, deg, final=0.0).collect()
    assert {(r.begin, r.end): r.page_id for r in got} == {(1, 3): 1, (5, 6): 3}
    assert {r.token for r in wikify.phrase_tokens(docs, known).collect()} == {"the", "red planet", "and", "god"}
    own = spark.createDataFrame([(1, 3, "planet", 4), (1, 9, "nowhere", 5)], "doc_id long, location int, anchor string, page_id long")
    assert rows(wikify.identity(docs, own)) == [(1, 4, "planet", 8, 14)]
    lines = wikify.corpus(docs, spark.createDataFrame([(1, 1, 3, 1)], "doc_id long, begin int, end int, page_id long"), spark.createDataFrame([(1, "/w/en/1/Mars")], "page_id long, url string"))
    assert lines.where("doc_id = 1").first().line == "The red_planet:/w/en/1/Mars and the god"
    u = wikify.universal_corpus(lines, spark.createDataFrame([("/w/en/1/Mars", 99)], "url string, univ_id long"), "en")
    assert u.where("doc_id = 1").first().line == "en:The en:red_planet /w/en/1/Mars /c/99 en:and en:the en:god"


def test_learnt_phrases(spark):
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(["new york"] + rng.choices("a b c d e f g h".split(), k=12))) for i in range(80)], "doc_id long, text string")
    got = {r.phrase for r in models.learn_phrases(docs, spark.createDataFrame([("new york",)], "phrase string"), 1).collect()}
    assert "new york" in got and len(got) < 10


def test_dumps(spark, tmp_path):
    import bz2

    xml = "<mediawiki><page><title>A &amp; B</title><ns>0</ns><id>7</id><revision><id>70</id><timestamp>2020-01-02T03:04:05Z</timestamp><text xml:space='preserve'>x &lt;b&gt; [[Y]]</text></revision></page>\n<page><title>R</title><ns>0</ns><id>8</id><redirect title=\"A\" /><revision><id>80</id><text>#REDIRECT [[A]]</text></revision></page></mediawiki>"
    with bz2.open(tmp_path / "d.xml.bz2", "wt") as f:
        f.write(xml)
    got = {r.page_id: r for r in dumps.pages(dumps.page_xml(spark, str(tmp_path / "d.xml.bz2")), 1).collect()}
    assert (got[7].title, got[7].body, got[7].revision_id, got[7].is_redirect) == ("A & B", "x <b> [[Y]]", 70, False)
    assert got[8].is_redirect and got[8].redirect_title == "A" and len(got) == 2
    (tmp_path / "l.sql").write_text("-- x\nINSERT INTO `pagelinks` VALUES (1,0,'It\\'s'),(2,0,'a,(b)'),(3,NULL,'c''d');\n")
    assert sorted((r.a, r.b, r.c) for r in dumps.sql_table(spark, str(tmp_path / "l.sql"), ["a", "b", "c"]).collect()) == [("1", "0", "It's"), ("2", "0", "a,(b)"), ("3", None, "c'd")]
    k = one(spark, dumps.file_kind(F.lit("/x/simplewiki-20200101-pages-articles2.xml.bz2")))
    assert (k.kind, k.lang, k.part) == ("articles", "simple", 2)


def test_readers(spark, tmp_path):
    (tmp_path / "pageviews-20240105-130000").write_text("en Main_Page 5 100\nen Caf%C3%A9 2 9\nxx No 1 1\nbad\n")
    got = rows(readers.view_file(spark, str(tmp_path / "pageviews-*"), {"en": 1}).select("title", "num_views", F.hour("tstamp")))
    assert got == [("Café", 2, 13), ("Main Page", 5, 13)]
    (tmp_path / "g.txt").write_text("a\tb\t4\nc\td\t0\nx\ty\tbad\n")
    assert [r.similarity for r in readers.gold(spark, str(tmp_path / "g.txt"), "g").orderBy("phrase1").collect()] == [1.0, 0.0]
    import struct

    (tmp_path / "v.bin").write_bytes(b"2 2\nfoo " + struct.pack("<2f", 3, 4) + b"\n/w/en/1/X " + struct.pack("<2f", 0, 2) + b"\n")
    v = readers.word_vectors(spark, str(tmp_path / "v.bin")).cache()
    assert {r.word: [round(x, 2) for x in r.embedding] for r in v.collect()} == {"foo": [0.6, 0.8], "/w/en/1/X": [0.0, 1.0]}
    pages, words = models.split_vectors(v)
    assert pages.first().page_id == 1 and words.first().phrase == "foo"
    (tmp_path / "c.txt").write_text("@Doc\t5\tFive\nline one\nline two\n@Doc\t6\tSix\nother\n")
    assert sorted((r.page_id, r.title, r.lines) for r in readers.corpus_docs(spark, str(tmp_path / "c.txt")).collect()) == [(5, "Five", ["line one", "line two"]), (6, "Six", ["other"])]
    e = spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "lang_id short, src_page_id int, dest_page_id int")
    readers.save(e, str(tmp_path / "store"), "redirect")
    assert rows(readers.load(spark, str(tmp_path / "store"), "redirect").select("lang_id", "src_page_id", "dest_page_id")) == rows(e)


def test_sentence_counts_take_all_sentences(spark, tmp_path):
    from quillgraph.plans import catalogue, q_text  # noqa: F401

    rows = [(1, "One two three. Four five six seven.", "en", "a"), (2, None, "en", "a"), (3, "One.", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_sentences, r.n_words, r.n_grams) for r in catalogue.QUERIES["sentence_counts"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 7, 8), 2: (0, 0, 0), 3: (1, 1, 0)}


def test_wikify_weighs_all_senses_by_matrix_or_by_rows(spark, tmp_path, monkeypatch):
    from quillgraph.plans import catalogue, q_text

    bench = [(k, f"word alpha beta{' word' * (k == 5)}") for k in range(1, 6)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a word of alpha beta", "en", "s"), (2, "nothing here", "en", "s"), (3, None, "en", "s"), (4, "word", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    known, senses, _ = q_text._known(spark, str(tmp_path))
    assert senses.where("phrase = 'alpha'").count() == 5  # no sense is dropped
    got = {}
    for most in (2048, 0):
        monkeypatch.setattr(wikify, "_PAGES", most)
        got[most] = [rows(catalogue.QUERIES[q](spark, str(tmp_path))) for q in ("wikify_documents", "wikify_combined")]
    assert got[2048] == got[0] and got[0][0]
    # n-grams that aren't known are never sent
    plan = wikify.spans(q_text.B.docs(spark, str(tmp_path)), known)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
