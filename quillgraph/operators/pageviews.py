"""Hourly page views: sums over intervals, loaded and missing hours, views by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import top


def _hour() -> Column:
    return F.expr("interval 1 hour")


def hourly(hits: DataFrame, page: Column, ts: Column, lang: Column | None = None) -> DataFrame:
    """(lang_id, page_id, tstamp, num_views) from single hits."""
    lang = F.lit(1).cast("short") if lang is None else lang
    return hits.select(lang.alias("lang_id"), page.alias("page_id"), F.date_trunc("hour", ts).alias("tstamp")).groupBy("lang_id", "page_id", "tstamp").agg(F.count("*").alias("num_views"))


def between(start: str, end: str, half_open: bool = False) -> Column:
    """Hours from start to end; the end counts unless ``half_open``."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return (F.col("tstamp") >= a) & (F.col("tstamp") < b if half_open else F.col("tstamp") <= b)


def views_of_pages(views: DataFrame, start: str, end: str, half_open: bool = False) -> DataFrame:
    """(page_id, views) of all pages in an interval; the condition reaches the scan."""
    return views.where(between(start, end, half_open)).groupBy("page_id").agg(F.sum("num_views").alias("views"))


def views_in_ranges(views: DataFrame, ranges: list[tuple[str, str]], pages: DataFrame | None = None, half_open: bool = False) -> DataFrame:
    """(page_id, views) over several intervals, which add: an hour in two of them counts twice.

    The intervals are a short list, so each row's weight is a sum of conditions and no join is needed.
    """
    weight = sum((F.when(between(a, b, half_open), 1).otherwise(0) for a, b in ranges), F.lit(0))
    v = views if pages is None else views.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    return v.select("page_id", (F.col("num_views") * weight).alias("n"), weight.alias("w")).where("w > 0").groupBy("page_id").agg(F.sum("n").alias("views"))


def top_pages(views: DataFrame, start: str, end: str, k: int = 10) -> DataFrame:
    """(rank, page_id, views): the k most viewed pages of each language in an interval."""
    v = views.where(between(start, end)).groupBy("lang_id", "page_id").agg(F.sum("num_views").alias("views"))
    return top(v, k, [F.desc("views"), F.asc("page_id")], ["lang_id"]).select("lang_id", "rank", "page_id", "views")


def loaded_hours(views: DataFrame) -> DataFrame:
    """(lang_id, hours): the hours that have been loaded, in order."""
    return views.select("lang_id", "tstamp").distinct().groupBy("lang_id").agg(F.sort_array(F.collect_list("tstamp")).alias("hours"))


def hour_grid(intervals: DataFrame) -> DataFrame:
    """(lang_id, tstamp): every hour stamp in [start, end) of the intervals (lang_id, start, end), each once."""
    first = F.date_trunc("hour", "start")
    first = F.when(first < F.col("start"), first + _hour()).otherwise(first)
    last = F.date_trunc("hour", F.col("end") - F.expr("interval 1 microsecond"))
    some = intervals.withColumn("__a", first).withColumn("__b", last).where("__a <= __b")
    return some.select("lang_id", F.explode(F.sequence("__a", "__b", _hour())).alias("tstamp")).distinct()


def missing_hours(intervals: DataFrame, views: DataFrame) -> DataFrame:
    """(lang_id, tstamp): hours of the intervals that aren't loaded."""
    return hour_grid(intervals).join(views.select("lang_id", "tstamp").distinct(), ["lang_id", "tstamp"], "left_anti")


def match_titles(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw rows (lang_id, title, tstamp, num_views) with their page's id; titles without a page go."""
    return raw.join(pages.select("lang_id", "title", "page_id"), ["lang_id", "title"]).groupBy("lang_id", "page_id", "tstamp").agg(F.sum("num_views").alias("num_views"))


def load_missing(raw: DataFrame, pages: DataFrame, views: DataFrame, intervals: DataFrame) -> DataFrame:
    """What has to be appended to ``views`` so that the intervals are loaded: a second call gives no rows."""
    needed = missing_hours(intervals, views)
    return match_titles(raw.join(needed, ["lang_id", "tstamp"], "left_semi"), pages)


def views_by_group(views: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """(group, views, pages): views and viewed pages of each group, from (page_id, group)."""
    per_page = views.groupBy("page_id").agg(F.sum("num_views").alias("v"))
    return per_page.join(members.select("page_id", group).distinct(), "page_id").groupBy(group).agg(F.sum("v").alias("views"), F.count("*").alias("pages"))
