"""Line dedup by overlapping windows of three lines, in DataFrame operations only.

Each three consecutive lines with text make a window, known by 128 bits of its lines' hashes: so many that among 10^12 windows
two unlike ones meet once in 10^14 runs. A window's first occurrence, by
document id and then position, stays; every later one covers the lines from its first to its last. Covered positions
of a document are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, own_name

SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, w, v, s, e): for each window its two hashes and the positions of its first and last line. ``th`` tells texts that share an id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc"), text.alias("text")).where(F.contains("text", F.lit("\n")) | F.lit(size == 1))
    lined = base.select("doc", F.xxhash64("text").alias("th"), F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t"))).alias("l"))
    full = lined.select("doc", "th", F.transform(F.filter("l", lambda x: x["t"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"))).alias("l")).where(F.size("l") >= size)
    made = F.transform(
        F.sequence(F.lit(0), F.size("l") - size),
        lambda k: F.struct(*[F.xxhash64(*[F.get("l", k + j)[h] for j in range(size)]).alias(w) for h, w in (("h", "w"), ("g", "v"))], F.get("l", k)["i"].alias("s"), F.get("l", k + (size - 1))["i"].alias("e")),
    )
    return full.select("doc", "th", F.explode(made).alias("x")).select("doc", "th", "x.w", "x.v", "x.s", "x.e")


def covered(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, gone): the sorted positions of the lines to remove, for documents that have some."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    all_windows = scratch.put(windows(docs, size, id_col, text_col), "windows")
    first = all_windows.groupBy("w", "v").agg(F.count("*").alias("n"), F.min(F.struct("doc", "s")).alias("first")).where("n > 1").select("w", "v", "first")
    first = scratch.put(first, "repeated")
    later = all_windows.join(first, ["w", "v"]).where(~F.col("first").eqNullSafe(F.struct("doc", "s")))
    spans = later.groupBy("doc", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return spans.select("doc", "th", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"]))))).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and the number of removed lines in ``removed_col``.

    Lines end at \\n and compare without spaces at their ends; lines of spaces alone belong to no window, but go when a
    removed window spans them. Texts with fewer than ``size`` lines of text have no window and stay as they are; a null
    text stays null. A document of which nothing is left has an empty text, and keeps its row. Of repeated rows that
    share an id all keep the first occurrence; a null id comes before all others. An empty table gives no rows. A
    column named like ``removed_col`` is replaced.
    """
    doc, th, own_th, gone, lines = (own_name(c, docs) for c in ("doc", "of_text", "text_hash", "gone", "lines"))
    found = covered(docs, size, id_col, text_col).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone))
    own = [c for c in docs.columns if c != removed_col]
    keyed = docs.select(*[F.col(c) for c in own], F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(own_th))
    got = keyed.join(found, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own_th) == F.col(th)), "left")
    got = got.withColumn(lines, F.when(F.col(gone).isNotNull(), _lines(F.col(text_col))))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return got.select(*[text.alias(c) if c == text_col else F.col(c) for c in own], removed.alias(removed_col))
