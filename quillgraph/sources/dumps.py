"""Dumps of a wiki: pages in XML, tables in SQL, and what the files' names tell. Compressed files (gz, bz2) are read as they are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

#: Kinds of dump files by a part of their names.
KINDS = {
    "articles": r"-pages-articles\d*\.xml", "meta_current": r"-pages-meta-current\d*\.xml", "meta_history": r"-pages-meta-history\d*\.xml", "abstracts": r"-abstract\d*\.xml",
    "logging": r"-pages-logging\d*\.xml", "stub": r"-stub-[a-z-]+\d*\.xml", "titles": r"-all-titles", "wikidata": r"^wikidata.*\.json", "page_views": r"^(?:pageviews|pagecounts)-\d{8}-\d{6}",
    "page": r"-page\.sql", "pagelinks": r"-pagelinks\.sql", "redirect": r"-redirect\.sql", "categorylinks": r"-categorylinks\.sql", "category": r"-category\.sql", "langlinks": r"-langlinks\.sql",
    "image": r"-image\.sql", "imagelinks": r"-imagelinks\.sql", "templatelinks": r"-templatelinks\.sql", "externallinks": r"-externallinks\.sql", "iwlinks": r"-iwlinks\.sql",
    "interwiki": r"-interwiki\.sql", "page_props": r"-page_props\.sql", "page_restrictions": r"-page_restrictions\.sql", "protected_titles": r"-protected_titles\.sql", "site_stats": r"-site_stats\.sql",
    "user_groups": r"-user_groups\.sql", "oldimage": r"-oldimage\.sql", "flaggedpages": r"-flaggedpages\.sql", "flaggedrevs": r"-flaggedrevs\.sql", "md5": r"-md5sums\.txt",
}
MAX_PAGE = 10 << 20


def file_kind(name: Column) -> Column:
    """struct(kind, lang, part) of a dump file's name; null kind if none fits."""
    base = F.element_at(F.split(name, "/"), -1)
    kind = F.coalesce(*[F.when(base.rlike(p), F.lit(k)) for k, p in KINDS.items()])
    lang = F.regexp_replace(F.nullif(F.regexp_extract(base, r"^([a-z_]+?)wiki-", 1), F.lit("")), "_", "-")
    part = F.nullif(F.regexp_extract(base, r"(\d+)\.(?:xml|sql)", 1), F.lit("")).cast("int")
    return F.struct(kind.alias("kind"), lang.alias("lang"), part.alias("part"))


def page_xml(spark: SparkSession, path: str) -> DataFrame:
    """(xml): each <page> element of dump files, as text; larger ones than MAX_PAGE characters are cut there.

    The reader splits files after the closing tag, so that one file's pages spread over tasks, and a page that the
    file's end cuts is still there.
    """
    raw = spark.read.option("lineSep", "</page>").text(path)
    at = F.locate("<page>", F.col("value"))
    return raw.where(at > 0).select(F.substring(F.expr("substring(value, locate('<page>', value))"), 1, MAX_PAGE).alias("xml"))


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pages(xml: DataFrame, lang_id: int) -> DataFrame:
    """Raw pages from page_xml(): the second id is the revision's; namespaces come by their number or the title's prefix."""
    x = F.col("xml")
    one = lambda p: F.regexp_extract(x, p, 1)
    ids = F.regexp_extract_all(x, F.lit(r"<id>(\d+)</id>"), F.lit(1))
    goal = F.nullif(_unescape(one(r'<redirect title="([^"]*)"')), F.lit(""))
    body = _unescape(one(r"(?s)<text[^>]*>(.*?)(?:</text>|$)"))
    title = _unescape(one(r"(?s)<title>(.*?)</title>"))
    dab = body.rlike(r"(?i)\{\{\s*(?:disambig|disambiguation|dab|hndis|geodis|begriffsklärung|homonymie|desambiguación)[^{}]*\}\}")
    got = xml.select(
        F.lit(lang_id).cast("short").alias("lang_id"), F.get(ids, F.lit(0)).try_cast("int").alias("page_id"), F.get(ids, F.lit(1)).try_cast("int").alias("revision_id"), body.alias("body"), title.alias("title"),
        F.try_to_timestamp(one(r"<timestamp>([^<]*)</timestamp>")).alias("last_edit"), F.coalesce(F.nullif(one(r"<ns>(-?\d+)</ns>"), F.lit("")), F.lit("0")).cast("short").alias("name_space"),
        (goal.isNotNull() | body.rlike(r"(?i)^\s*#redirect")).alias("is_redirect"), dab.alias("is_disambig"), goal.alias("redirect_title"),
    )
    return got.where("page_id is not null")


def local_pages(raw: DataFrame) -> DataFrame:
    return raw.select(*[c.split(" ")[0] for c in S.LOCAL_PAGE.split(", ")])


def tuples(line: str) -> list[list[str | None]]:
    """The rows of an INSERT statement, values as text; other lines give none."""
    at = line.find("VALUES")
    if not line.startswith("INSERT") or at < 0:
        return []
    rows: list[list[str | None]] = []
    row: list[str | None] | None = None
    i, n = at + 6, len(line)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
    while i < n:
        c = line[i]
        if row is None:
            if c == "(":
                row = []
            i += 1
        elif c == "'":
            out, i = [], i + 1
            while i < n and line[i] != "'" or line[i : i + 2] == "''":
                if line[i] == "\\" and i + 1 < n:
                    out.append(escapes.get(line[i + 1], line[i + 1]))
                    i += 2
                elif line[i] == "'":
                    out.append("'")
                    i += 2
                else:
                    out.append(line[i])
                    i += 1
            row.append("".join(out))
            i += 1
        elif c == ")":
            rows.append(row)
            row, i = None, i + 1
        elif c in ", ":
            i += 1
        else:
            j = i
            while j < n and line[j] not in ",)":
                j += 1
            v = line[i:j].strip()
            row.append(None if v == "NULL" else v)
            i = j
    return rows


def sql_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a table's dump as strings; rows of another width go. Statements are lines, which spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for line in b.column(0).to_pylist():
                rows = [r for r in tuples(line or "") if len(r) == len(columns)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], columns)

    return spark.read.text(path).mapInArrow(run, ", ".join(f"{c} string" for c in columns))
