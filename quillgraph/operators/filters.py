"""Predicates: conjunctions of IN-lists and flags, as Columns that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S


def _all(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _among(column: str, values: Iterable | None) -> list[Column]:
    values = None if values is None else list(values)
    return [F.col(column).isin(values)] if values else []  # none and empty: unconstrained


@dataclass
class PageFilter:
    """Pages by language, namespace and flags; ``limit`` is of rows."""

    langs: Iterable | None = None
    name_spaces: Iterable | None = None
    is_redirect: bool | None = None
    is_disambig: bool | None = None
    ids: Iterable | None = None
    titles: Iterable | None = None
    limit: int | None = None

    def column(self) -> Column:
        flags = [F.col(c) == v for c, v in (("is_redirect", self.is_redirect), ("is_disambig", self.is_disambig)) if v is not None]
        return _all(_among("lang_id", self.langs) + _among("name_space", self.name_spaces) + _among("page_id", self.ids) + _among("title", self.titles) + flags)

    def apply(self, pages: DataFrame) -> DataFrame:
        out = pages.where(self.column())
        return out if self.limit is None else out.limit(self.limit)


@dataclass
class LinkFilter:
    """Links; ``has_dest`` true asks for known targets, false for red links."""

    langs: Iterable | None = None
    source_ids: Iterable | None = None
    dest_ids: Iterable | None = None
    location_types: Iterable | None = None
    is_parseable: bool | None = None
    has_dest: bool | None = None
    limit: int | None = None

    def column(self) -> Column:
        preds = _among("lang_id", self.langs) + _among("source_id", self.source_ids) + _among("dest_id", self.dest_ids) + _among("location_type", self.location_types)
        if self.is_parseable is not None:
            preds.append(F.col("is_parseable") == self.is_parseable)
        if self.has_dest is not None:
            preds.append(F.col("dest_id") != -1 if self.has_dest else F.col("dest_id") == -1)
        return _all(preds)

    def apply(self, links: DataFrame) -> DataFrame:
        out = links.where(self.column())
        return out if self.limit is None else out.limit(self.limit)


@dataclass
class ViewFilter:
    """Page views by page and language, numbers of views and hours, both ends included unless ``half_open``."""

    langs: Iterable | None = None
    page_ids: Iterable | None = None
    min_views: int | None = None
    max_views: int | None = None
    start: str | None = None
    end: str | None = None
    half_open: bool = False

    def column(self) -> Column:
        preds = _among("lang_id", self.langs) + _among("page_id", self.page_ids)
        preds += [F.col("num_views") >= self.min_views] if self.min_views is not None else []
        preds += [F.col("num_views") <= self.max_views] if self.max_views is not None else []
        preds += [F.col("tstamp") >= F.lit(self.start).cast("timestamp")] if self.start is not None else []
        if self.end is not None:
            end = F.lit(self.end).cast("timestamp")
            preds.append(F.col("tstamp") < end if self.half_open else F.col("tstamp") <= end)
        return _all(preds)

    def apply(self, views: DataFrame) -> DataFrame:
        return views.where(self.column())


@dataclass
class StatementFilter:
    """Statements of entities by type, entity, property, rank and value; each filter acts on its own column."""

    entity_types: Iterable | None = None
    entity_ids: Iterable | None = None
    prop_ids: Iterable | None = None
    ranks: Iterable | None = None
    values: Iterable | None = None
    limit: int | None = field(default=None)

    def apply(self, statements: DataFrame) -> DataFrame:
        out = statements.where(_all(_among("entity_type", self.entity_types) + _among("entity_id", self.entity_ids) + _among("prop_id", self.prop_ids) + _among("rank", self.ranks) + _among("val_str", self.values)))
        return out if self.limit is None else out.limit(self.limit)


def normal_page() -> Column:
    """An article that is neither redirect nor disambiguation page."""
    return (F.col("name_space") == S.ARTICLE) & ~F.col("is_redirect") & ~F.col("is_disambig")


def valid_page(f: PageFilter) -> Column:
    """As a value of each row; false for a missing page."""
    return F.coalesce(F.col("page_id").isNotNull() & f.column(), F.lit(False))


def location_class(paragraph: Column, section: Column) -> Column:
    return F.when(paragraph == 0, S.FIRST_PARA).when(section == 0, S.FIRST_SEC).otherwise(S.NO_LOCATION)


def is_talk(name_space: Column) -> Column:
    return (name_space > 0) & (name_space % 2 == 1)


def namespace_of(name: Column) -> Column:
    """A namespace's number by one of its names; null if unknown."""
    m = F.create_map(*[F.lit(x) for kv in S.NAMESPACES.items() for x in kv])
    return F.element_at(m, F.lower(F.trim(F.regexp_replace(name, "_", " "))))


def is_list_title(title: Column) -> Column:
    return F.lower(title).startswith("list")


def is_blacklisted(title: Column) -> Column:
    """Years, days of a month, numbers and lists make poor concepts."""
    month = "(January|February|March|April|May|June|July|August|September|October|November|December)"
    return title.rlike(r"^[0-9]{4}( .*)?$") | title.rlike(rf"^{month} [0-9]{{1,2}}$") | title.rlike(r"^[0-9]+$") | is_list_title(title)


def is_real(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def point_precision(lon: Column, lat: Column) -> Column:
    return F.when((lon != F.floor(lon)) | (lat != F.floor(lat)), "HIGH").otherwise("LOW")


def in_language_set(langs: Column, wanted: Column, every: bool = False) -> Column:
    return F.size(F.array_except(wanted, langs)) == 0 if every else F.arrays_overlap(langs, wanted)


def clarity(concepts: DataFrame) -> DataFrame:
    """(univ_id, clarity): languages by entities; 1 where each language has one page."""
    return concepts.groupBy("univ_id").agg((F.countDistinct("lang_id") / F.count("*")).alias("clarity"))


def prune_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is in the table ``ids``; Spark broadcasts it when it is small."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def map_features(vectors: DataFrame, value: Column) -> DataFrame:
    """A vector-to-vector hook: a new value for each entry; entries that become null or 0 go."""
    return vectors.withColumn("value", value).where("value is not null and value <> 0")


@dataclass
class LanguageFilter:
    """Category members or redirects: what these tables are scanned by is the language, and the number of rows."""

    langs: Iterable | None = None
    limit: int | None = None

    def apply(self, table: DataFrame) -> DataFrame:
        out = table.where(_all(_among("lang_id", self.langs)))
        return out if self.limit is None else out.limit(self.limit)


def redirect_flags(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """(page_id, redirects): whether each asked page is a redirect."""
    known = redirects.select(F.col("src_page_id").alias("page_id")).distinct().withColumn("redirects", F.lit(True))
    return pages.select("page_id").join(known, "page_id", "left").withColumn("redirects", F.coalesce("redirects", F.lit(False)))
