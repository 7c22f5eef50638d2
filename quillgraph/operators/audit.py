"""What loads have written: counters by component and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def cumulate(counts: DataFrame) -> DataFrame:
    """Increments merged: (component, lang_id, num_records, num_errors, last_updated)."""
    return counts.groupBy("component", "lang_id").agg(F.sum("num_records").alias("num_records"), F.sum("num_errors").alias("num_errors"), F.max("last_updated").alias("last_updated"))


def report(counts: DataFrame) -> DataFrame:
    """Counters by component and language, and by component over all languages (lang_id null, level 1)."""
    r = counts.rollup("component", "lang_id").agg(F.sum("num_records").alias("num_records"), F.sum("num_errors").alias("num_errors"), F.grouping_id().alias("level"))
    return r.where("level < 3")


def loaded_languages(counts: DataFrame, component: str) -> DataFrame:
    return counts.where((F.col("component") == component) & F.col("lang_id").isNotNull() & (F.col("num_records") > 0)).select("lang_id").distinct()


def observed(df: DataFrame, component: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while it is written, without a second pass."""
    seen = Observation(component)
    return df.observe(seen, F.count("*").alias("num_records")), seen
