"""Queries that write files of the engine's formats to the shared folder and read them again: sources and sinks end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import normalize, pageviews, wikidata
from ..operators.graph import shared_folder
from ..session import table
from ..sources import dumps, readers
from . import bind as B
from . import training
from .bind import r
from .catalogue import query
from .q_other import GOLD, _entities, _gold


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quillgraph-files/{name}-{uuid.uuid4().hex[:12]}"


def _text(df, column, folder: str) -> str:
    df.select(column.alias("value")).write.text(folder)
    return folder


@query(f"WITH {B.PAGES} SELECT lang_id::SMALLINT AS lang_id, page_id::INTEGER AS page_id, title, name_space::SMALLINT AS name_space, is_redirect, is_disambig FROM pages")
def stored_pages(spark, d):
    """A table saved by language and loaded again."""
    root = _folder(spark, "store")
    readers.save(B.pages(spark, d), root, "local_page")
    return readers.load(spark, root, "local_page").select("lang_id", "page_id", "title", "name_space", "is_redirect", "is_disambig")


@query("""SELECT p_partkey::INTEGER AS page_id, (p_partkey + 500000)::INTEGER AS revision_id, 'Part & ' || p_name AS title, (CASE WHEN p_partkey % 10 = 0 THEN 14 ELSE 0 END)::SMALLINT AS name_space, p_partkey % 7 = 0 AS is_redirect, p_partkey % 11 = 0 AND p_partkey % 7 > 0 AS is_disambig,
CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS redirect_title, length(CASE WHEN p_partkey % 7 = 0 THEN '#REDIRECT [[' || p_brand || ']]' ELSE '''''''' || p_type || ' <b>&</b>' || CASE WHEN p_partkey % 11 = 0 THEN ' {{disambig}}' ELSE '' END END)::INTEGER AS n_chars FROM part""")
def dumped_pages(spark, d):
    """Pages from an XML dump, with what is escaped in it."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    red = k % 7 == 0
    body = F.when(red, F.concat(F.lit("#REDIRECT [["), "p_brand", F.lit("]]"))).otherwise(F.concat(F.lit("'''"), "p_type", F.lit(" &lt;b&gt;&amp;&lt;/b&gt;"), F.when(k % 11 == 0, " {{disambig}}").otherwise("")))
    parts = [
        "<page><title>Part &amp; ", F.col("p_name"), "</title><ns>", F.when(k % 10 == 0, "14").otherwise("0"), "</ns><id>", k.cast("string"), "</id>", F.when(red, F.concat(F.lit('<redirect title="'), "p_brand", F.lit('" />'))).otherwise(""),
        "<revision><id>", (k + 500_000).cast("string"), "</id><timestamp>2020-01-01T00:00:00Z</timestamp><text xml:space=\"preserve\">", body, "</text></revision></page>",
    ]
    path = _text(p, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]), _folder(spark, "xml"))
    got = dumps.pages(dumps.page_xml(spark, path), 1)
    return got.select("page_id", "revision_id", "title", "name_space", "is_redirect", "is_disambig", "redirect_title", F.char_length("body").alias("n_chars"))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 > 0 THEN 'It''s (' || p_name || '), a\\b' END AS title, p_size::VARCHAR AS n FROM part")
def dumped_rows(spark, d):
    """Rows from the INSERT statements of a table's dump: quotes, brackets, commas and escapes within values."""
    k = F.col("p_partkey")
    title = F.when(k % 5 > 0, F.concat(F.lit("'It\\'s ("), "p_name", F.lit("), a\\\\b'"))).otherwise("NULL")
    row = F.concat(F.lit("("), k.cast("string"), F.lit(","), title, F.lit(","), F.col("p_size").cast("string"), F.lit(")"))
    lines = table(spark, d, "part").groupBy((k % 40).alias("g")).agg(F.concat(F.lit("INSERT INTO `t` VALUES "), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit(";")).alias("v"))
    return dumps.sql_table(spark, _text(lines, F.col("v"), _folder(spark, "sql")), ["id", "title", "n"])


@query("""SELECT (p_partkey % 2 + 1)::INTEGER AS lang_id, 'Part ' || p_partkey::VARCHAR || ' été' AS title, TIMESTAMP '2024-01-02 03:00:00' AS tstamp, p_size::INTEGER AS num_views FROM part WHERE p_partkey % 3 < 2""")
def hourly_view_files(spark, d):
    """Hourly files of views: languages that aren't asked for go, titles are decoded."""
    k = F.col("p_partkey")
    lang = F.when(k % 3 == 2, "xx").when(k % 2 == 0, "en").otherwise("de")
    line = F.concat(lang, F.lit(" Part_"), k.cast("string"), F.lit("_%C3%A9t%C3%A9 "), F.col("p_size").cast("string"), F.lit(" 1000"))
    path = _text(table(spark, d, "part"), line, _folder(spark, "views") + "/pageviews-20240102-030000")
    return readers.view_file(spark, path, {"en": 1, "de": 2}).select("lang_id", "title", "tstamp", "num_views")


@query("SELECT 'parts' AS dataset, p_name AS phrase1, p_type || p_partkey::VARCHAR AS phrase2, round((p_size - (SELECT min(p_size) FROM part))::DOUBLE / (SELECT max(p_size) - min(p_size) FROM part), 9) AS similarity FROM part")
def gold_files(spark, d):
    """A gold set exported with a header and read again, its scores brought to 0..1."""
    path = _folder(spark, "gold")
    readers.export(table(spark, d, "part").select(F.col("p_name").alias("phrase1"), F.concat("p_type", F.col("p_partkey").cast("string")).alias("phrase2"), F.col("p_size").alias("similarity")), path)
    return readers.gold(spark, path, "parts").select("dataset", "phrase1", "phrase2", r("similarity", 9))


@query("SELECT p_partkey AS page_id, p_name AS title, 2 AS n_lines, p_type AS first_line FROM part")
def corpus_files(spark, d):
    """Documents of a corpus, each opened by a marker."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("@Doc\t"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name", F.lit("\n"), "p_type", F.lit("\n\nlast line"))
    got = readers.corpus_docs(spark, _text(p, text, _folder(spark, "corpus")))
    return got.select("page_id", "title", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


@query("SELECT p_name || ' ' || p_partkey::VARCHAR AS phrase, 'A title ' || p_size::VARCHAR AS title, p_size::BIGINT AS count FROM part WHERE p_partkey % 4 > 0")
def phrase_dictionary_files(spark, d):
    """A dictionary of phrases with the counts of its flags; lines without counts go."""
    k = F.col("p_partkey")
    flag = F.when(k % 4 == 0, "x").otherwise(F.concat(F.lit("KB W:"), F.col("p_size").cast("string"), F.lit("/99 d")))
    line = F.concat("p_name", F.lit(" "), k.cast("string"), F.lit("\t0.5 A_title_"), F.col("p_size").cast("string"), F.lit(" "), flag)
    return readers.phrase_dictionary(spark, _text(table(spark, d, "part"), line, _folder(spark, "phrases"))).select("phrase", "title", "count")


@query("SELECT i::VARCHAR AS region_id, 0::INTEGER AS ring, 3 AS n, i * 1.5::DOUBLE AS lon FROM range(200) t(i)")
def region_files(spark, d):
    x = (F.col("id") * 1.5).cast("string")
    line = F.concat(F.col("id").cast("string"), F.lit("\t0\t"), x, F.lit(" 1.0,"), x, F.lit(" 2.0, 7.5 3.0"))
    got = readers.regions_csv(spark, _text(spark.range(200), line, _folder(spark, "regions")))
    return got.select("region_id", "ring", F.size("path").alias("n"), F.get("path", F.lit(0))["lon"].alias("lon"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'zh-min-nan' ELSE 'en' END AS lang, (CASE WHEN p_partkey % 5 = 2 THEN p_partkey END)::INTEGER AS part, p_partkey % 5 < 4 AS known FROM part""")
def dump_file_names(spark, d):
    """Which dump files' names mean what."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "/d/dewiki-20200101-page.sql.gz").when(k % 5 == 1, "zh_min_nanwiki-20200101-langlinks.sql.gz").when(k % 5 == 2, F.concat(F.lit("enwiki-20200101-pages-articles"), k.cast("string"), F.lit(".xml-p1p2.bz2"))).when(k % 5 == 3, "enwiki-20200101-pagelinks.sql.gz").otherwise("enwiki-20200101-readme.txt")
    f = table(spark, d, "part").select(k.alias("k"), dumps.file_kind(name).alias("f"))
    return f.select("k", "f.lang", "f.part", F.col("f.kind").isNotNull().alias("known"))


@query("SELECT p_partkey::INTEGER AS entity_id, (CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END)::INTEGER AS n_labels FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 31, 1")
def kept_entities(spark, d):
    """Properties and the items that are concepts at hand, with texts of the asked languages only."""
    concepts = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("univ_id"))
    return wikidata.keep_entities(_entities(spark, d), ["en"], concepts).select("entity_id", F.size("labels").alias("n_labels"))


@query(f"WITH {B.POINTS} SELECT id::INTEGER AS item_id, lon, lat FROM points WHERE id % 3 > 0")
def item_points(spark, d):
    """Coordinates on earth from statements: other globes go."""
    p = B.points(spark, d)
    globe = F.when(F.col("id") % 3 == 0, "http://www.wikidata.org/entity/Q405").otherwise("http://www.wikidata.org/entity/Q2")
    val = F.to_json(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), globe.alias("globe")))
    st = p.select(F.concat(F.lit("q$"), F.col("id").cast("string")).alias("id"), F.lit("Q").alias("entity_type"), F.col("id").cast("int").alias("entity_id"), F.lit(625).alias("prop_id"), F.lit("OTHER").alias("val_type"), val.alias("val_str"))
    return wikidata.points(st)


@query(f"WITH {B.VIEWS}, h AS (SELECT DISTINCT tstamp FROM views WHERE lang_id = 1 AND tstamp < TIMESTAMP '2024-01-03' AND hour(tstamp) % 2 = 0) SELECT 1::INTEGER AS lang_id, p_partkey AS page_id, g.t AS tstamp, 2::BIGINT AS num_views FROM part CROSS JOIN (SELECT TIMESTAMP '2024-01-01' + i * INTERVAL 1 HOUR AS t FROM range(48) x(i)) g WHERE p_partkey % 200 = 0 AND g.t NOT IN (SELECT tstamp FROM h)")
def appended_views(spark, d):
    """Raw views of the hours that aren't loaded yet."""
    have = B.views(spark, d).where("lang_id = 1 and tstamp < timestamp '2024-01-03' and hour(tstamp) % 2 = 0")
    pages = table(spark, d, "part").where("p_partkey % 200 = 0").select(F.lit(1).alias("lang_id"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("title"), F.col("p_partkey").alias("page_id"))
    interval = spark.range(1).select(F.lit(1).alias("lang_id"), F.lit("2024-01-01").cast("timestamp").alias("start"), F.lit("2024-01-03").cast("timestamp").alias("end"))
    hours = pageviews.hour_grid(interval)
    raw = pages.join(hours, "lang_id").select("lang_id", "title", "tstamp", F.lit(2).cast("long").alias("num_views"))
    return pageviews.load_missing(raw, pages, have, interval).select("lang_id", "page_id", "tstamp", "num_views")


@query(f"WITH {GOLD}, m AS (SELECT min(score) AS a, max(score) AS b, min(1 + score) AS c FROM gold) SELECT doc_id, round(((score - a) / (b - a) + CASE WHEN 1 + score < c THEN 0 ELSE ln(c + score) END) / 2, 6) AS score FROM gold, m")
def trained_metrics(spark, d):
    """Metrics trained in the order of what they need: two normalizers, and their mean, which needs both."""
    metrics = {
        "mean": training.Metric("mean", lambda rows, have: lambda x: (have["range"].apply(x) + have["log"].apply(x)) / 2, ("range", "log")),
        "range": training.Metric("range", lambda rows, have: normalize.Range().fit(rows, "score")),
        "log": training.Metric("log", lambda rows, have: normalize.Log().fit(rows, "score")),
    }
    g = _gold(spark, d)
    return g.select("doc_id", F.round(training.build(metrics, ["mean"], g)["mean"](F.col("score")), 6).alias("score"))
