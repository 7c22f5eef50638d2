"""Wiki markup as rows: links, categories, languages, redirects, with where they stand.

Brackets nest, so a page is walked by a small scanner in Arrow batches; one pass gives rows of all kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "lang_id int, page_id long, kind string, target string, anchor string, section int, paragraph int, location int, in_template boolean"
_NAMES = ["lang_id", "page_id", "kind", "target", "anchor", "section", "paragraph", "location", "in_template"]
_KINDS = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
_REDIRECT = re.compile(r"^\s*#\s*(?:redirect|weiterleitung|redirection|redirección)\s*:?\s*\[\[([^\]|#]+)", re.I)
_CATEGORY = re.compile(r"^\s*(?:category|kategorie|catégorie|categoría)\s*:\s*(.+)$", re.I | re.S)
_FILE = re.compile(r"^\s*(?:file|image|datei|bild|fichier|archivo)\s*:", re.I)
_LANG = re.compile(r"^\s*([a-z]{2,3}(?:-[a-z]+)?|simple)\s*:\s*(.+)$", re.S)
_HEAD = re.compile(r"^(=+)\s*(.*?)\s*\1\s*$", re.M)
_SEE = re.compile(r"^\s*(?:see also|siehe auch|voir aussi|véase también)\s*$", re.I)
_MAIN = re.compile(r"\{\{\s*(main|main article|hauptartikel|article détaillé|see also|details|further)\s*\|([^{}]*)\}\}", re.I)
_TOKEN = re.compile(r"\[\[|\]\]|\{\{|\}\}|<!--.*?-->|<nowiki>.*?</nowiki>|\n[ \t]*\n|\n(?==)", re.S | re.I)


def scan(text: str) -> list[tuple]:
    """(kind, target, anchor, section, paragraph, location, in_template) of a page; kinds: redirect, link, category, language, seealso, main."""
    m = _REDIRECT.match(text)
    if m:
        return [("redirect", m[1].strip(), None, 0, 0, m.start(1), False)]
    out, stack, braces, section, paragraph, see = [], [], 0, 0, 0, False
    for m in _MAIN.finditer(text):
        for t in m[2].split("|"):
            if t.strip() and "=" not in t:
                out.append(("main" if "see" not in m[1].lower() else "seealso", t.strip(), None, text.count("\n=", 0, m.start()), 0, m.start(), True))
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t == "[[":
            stack.append((m.end(), section, paragraph))
        elif t == "]]":
            if stack:
                start, sec, par = stack.pop()
                row = _link(text[start : m.start()], bool(stack))
                if row:
                    kind, target, anchor = row
                    out.append(("seealso" if see and kind == "link" else kind, target, anchor, sec, par, start - 2, braces > 0))
        elif t == "{{":
            braces += 1
        elif t == "}}":
            braces = max(0, braces - 1)
        elif t[0] == "\n":
            paragraph += 1
            if text[m.end() : m.end() + 1] == "=":
                head = _HEAD.match(text, m.end())
                if head:
                    section += 1
                    see = bool(_SEE.match(head[2]))
    return sorted(out, key=lambda r: (r[5], r[0]))


def _link(inner: str, nested: bool) -> tuple | None:
    target, _, anchor = inner.partition("|")
    anchor = anchor.rsplit("|", 1)[-1]
    if "\n" in target or not target.strip() or _FILE.match(target):
        return None
    escaped = target.lstrip().startswith(":")
    bare = target.strip().lstrip(":").strip()
    c = None if escaped else _CATEGORY.match(target)
    if c:
        return None if nested else ("category", c[1].strip(), None)
    m = None if escaped else _LANG.match(target)
    if m:
        return None if nested else ("language", f"{m[1]}:{m[2].strip()}", None)
    bare = bare.split("#")[0].strip()
    return ("link", bare, (anchor or target.strip().lstrip(":")).strip()) if bare else None


def parse(raw: DataFrame) -> DataFrame:
    """SCHEMA rows from (lang_id, page_id, body); a null body gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                lang, page, body = (c.to_pylist() for c in b.slice(at, 256).columns)
                rows = [(a, p, *r) for a, p, t in zip(lang, page, body, strict=True) for r in scan(t or "")]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)

    return raw.select(F.col("lang_id").cast("int"), F.col("page_id").cast("long"), F.col("body").cast("string")).mapInArrow(run, SCHEMA)


def links(parsed: DataFrame) -> DataFrame:
    """(lang_id, source_id, dest_title, anchor_text, location, is_parseable, location_type): links by title."""
    from ..operators.filters import location_class
    from .text import canonical_title

    p = parsed.where("kind in ('link', 'seealso', 'main')")
    return p.select("lang_id", F.col("page_id").alias("source_id"), canonical_title(F.col("target")).alias("dest_title"), F.coalesce("anchor", "target").alias("anchor_text"), "location", (~F.col("in_template")).alias("is_parseable"), location_class(F.col("paragraph"), F.col("section")).cast("short").alias("location_type"))


def categories(parsed: DataFrame) -> DataFrame:
    """(lang_id, article_id, category_title)"""
    from .text import capitalise

    t = F.trim(F.regexp_replace(F.regexp_replace("target", "_", " "), r"[|#].*$", ""))
    return parsed.where("kind = 'category'").select("lang_id", F.col("page_id").alias("article_id"), capitalise(t).alias("category_title")).distinct()


def languages(parsed: DataFrame) -> DataFrame:
    """(lang_id, source_id, dest_lang, dest_title)"""
    return parsed.where("kind = 'language'").select("lang_id", F.col("page_id").alias("source_id"), F.split_part("target", F.lit(":"), F.lit(1)).alias("dest_lang"), F.trim(F.regexp_replace("target", "^[^:]*:", "")).alias("dest_title"))


def redirects(parsed: DataFrame) -> DataFrame:
    """(lang_id, src_page_id, dest_title)"""
    from .text import canonical_title

    return parsed.where("kind = 'redirect'").select("lang_id", F.col("page_id").alias("src_page_id"), canonical_title(F.col("target")).alias("dest_title"))
