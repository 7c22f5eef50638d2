"""Entities of a knowledge base: labels, statements and what they say about pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANKS = {"deprecated": 0, "normal": 1, "preferred": 2}
_SNAK = "struct<property:string,snaktype:string,datatype:string,datavalue:struct<type:string,value:string>>"
ENTITY = (
    "id string, type string, labels map<string,struct<language:string,value:string>>, descriptions map<string,struct<language:string,value:string>>, "
    f"aliases map<string,array<struct<language:string,value:string>>>, claims map<string,array<struct<id:string,rank:string,mainsnak:{_SNAK}>>>, "
    "sitelinks map<string,struct<site:string,title:string>>"
)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entities from lines of JSON; array brackets, trailing commas and unreadable lines go."""
    text = F.regexp_replace(F.trim(F.col(column)), r",$", "")
    e = lines.where(~text.isin("[", "]", "")).select(F.from_json(text, ENTITY).alias("e")).where("e.id is not null").select("e.*")
    return e.withColumn("entity_type", F.upper(F.substring("id", 1, 1))).withColumn("entity_id", F.regexp_extract("id", r"^[A-Za-z]([0-9]+)$", 1).try_cast("int"))


def labels(entities: DataFrame, field: str = "labels") -> DataFrame:
    """(entity_type, entity_id, lang, label) of labels or descriptions."""
    return entities.select("entity_type", "entity_id", F.explode(F.map_entries(field)).alias("x")).select("entity_type", "entity_id", F.col("x.key").alias("lang"), F.col("x.value.value").alias("label"))


def aliases(entities: DataFrame) -> DataFrame:
    e = entities.select("entity_type", "entity_id", F.explode(F.map_entries("aliases")).alias("x")).select("entity_type", "entity_id", F.col("x.key").alias("lang"), F.explode("x.value").alias("v"))
    return e.select("entity_type", "entity_id", "lang", F.col("v.value").alias("alias"))


def statements(entities: DataFrame) -> DataFrame:
    """(id, entity_type, entity_id, prop_id, val_type, val_str, rank): one row for each claim.

    Value types are ITEM, PROPERTY, TIME, STRING, INT, NOVALUE, SOMEVALUE and OTHER, whose JSON is kept as it is.
    """
    c = entities.select("entity_type", "entity_id", F.explode(F.map_entries("claims")).alias("x"))
    c = c.select("entity_type", "entity_id", F.regexp_extract("x.key", r"([0-9]+)$", 1).try_cast("int").alias("prop_id"), F.explode("x.value").alias("c"))
    v, kind = F.col("c.mainsnak.datavalue.value"), F.col("c.mainsnak.datavalue.type")
    target = F.get_json_object(v, "$.entity-type")
    val_type = (
        F.when(F.col("c.mainsnak.snaktype") == "novalue", "NOVALUE")
        .when(F.col("c.mainsnak.snaktype") == "somevalue", "SOMEVALUE")
        .when((kind == "wikibase-entityid") & (target == "property"), "PROPERTY")
        .when(kind == "wikibase-entityid", "ITEM")
        .when(kind == "time", "TIME")
        .when(kind == "string", "STRING")
        .when(kind == "quantity", "INT")
        .otherwise("OTHER")
    )
    c = c.withColumn("val_type", val_type)
    val = (
        F.when(F.col("val_type").isin("ITEM", "PROPERTY"), F.coalesce(F.get_json_object(v, "$.numeric-id"), F.regexp_extract(F.get_json_object(v, "$.id"), r"([0-9]+)$", 1)))
        .when(F.col("val_type") == "TIME", F.get_json_object(v, "$.time"))
        .when(F.col("val_type") == "INT", F.regexp_replace(F.get_json_object(v, "$.amount"), r"^\+", ""))
        .otherwise(v)
    )
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("c.rank")).cast("short")
    return c.select(F.col("c.id").alias("id"), "entity_type", "entity_id", "prop_id", "val_type", val.alias("val_str"), rank.alias("rank"))


def sitelinks(entities: DataFrame) -> DataFrame:
    """(entity_id, lang, title) of items' links to encyclopedias; other projects' sites go."""
    s = entities.where("entity_type = 'Q'").select("entity_id", F.explode(F.map_entries("sitelinks")).alias("x"))
    s = s.select("entity_id", F.regexp_replace(F.regexp_extract("x.key", r"^([a-z_]+)wiki$", 1), "_", "-").alias("lang"), F.col("x.value.title").alias("title"))
    return s.where("lang <> '' and lang not in ('commons', 'species', 'meta', 'wikidata')")


def keep_entities(entities: DataFrame, langs: list[str], concepts: DataFrame | None = None, labelled: bool = False) -> DataFrame:
    """Properties, items that are concepts at hand, and with ``labelled`` all that have a label; texts of other languages go."""
    keep = F.col("entity_type") == "P"
    e = entities
    if concepts is not None:
        known = concepts.select(F.col("univ_id").alias("__u")).distinct()
        e = e.join(known, F.col("entity_id") == F.col("__u"), "left")
        keep = keep | ((F.col("entity_type") == "Q") & F.col("__u").isNotNull())
    for f in ("labels", "descriptions", "aliases"):
        e = e.withColumn(f, F.map_filter(f, lambda k, _: k.isin(langs)))
    if labelled:
        keep = keep | (F.size("labels") > 0)
    return e.where(keep).select(*entities.columns)


def best_label(labelled: DataFrame, langs: list[str]) -> DataFrame:
    """(entity_type, entity_id, label): in the first language of ``langs`` that has one, else in any, by name of language."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")), F.lit(0))
    key = F.struct(F.when(order == 0, len(langs) + 1).otherwise(order).alias("o"), F.col("lang"), F.col("label"))
    return labelled.groupBy("entity_type", "entity_id").agg(F.min(key).alias("b")).select("entity_type", "entity_id", F.col("b.label").alias("label"))


def localise(st: DataFrame, labelled: DataFrame, langs: list[str]) -> DataFrame:
    """(item, property, value): statements in words; "unknown" where nothing has a label."""
    names = best_label(labelled, langs)
    item = names.select("entity_type", "entity_id", F.col("label").alias("item"))
    prop = names.where("entity_type = 'P'").select(F.col("entity_id").alias("prop_id"), F.col("label").alias("property"))
    value = names.select(F.col("entity_type").alias("v_type"), F.col("entity_id").cast("string").alias("val_str"), F.col("label").alias("named"))
    j = st.withColumn("v_type", F.when(F.col("val_type") == "ITEM", "Q").when(F.col("val_type") == "PROPERTY", "P"))
    j = j.join(item, ["entity_type", "entity_id"], "left").join(prop, "prop_id", "left").join(value, ["v_type", "val_str"], "left")
    unknown = F.lit("unknown")
    shown = F.when(F.col("v_type").isNotNull(), F.coalesce("named", unknown)).otherwise(F.coalesce("val_str", unknown))
    return j.select("entity_type", "entity_id", "prop_id", F.coalesce("item", unknown).alias("item"), F.coalesce("property", unknown).alias("property"), shown.alias("value"))


def property_by_name(labelled: DataFrame, aliased: DataFrame, name: str) -> DataFrame:
    """(entity_id): properties with that label or alias."""
    by = labelled.where("entity_type = 'P'").select("entity_id", F.col("label").alias("n")).unionByName(aliased.where("entity_type = 'P'").select("entity_id", F.col("alias").alias("n")))
    return by.where(F.lower("n") == name.lower()).select("entity_id").distinct()


def concepts_with_value(st: DataFrame, prop_id: int, value: str) -> DataFrame:
    return st.where((F.col("entity_type") == "Q") & (F.col("prop_id") == prop_id) & (F.col("val_str") == value)).select(F.col("entity_id").alias("univ_id")).distinct()


def pages_with_value(st: DataFrame, concepts: DataFrame, prop_id: int, value: str, lang_id: int) -> DataFrame:
    return concepts.where(F.col("lang_id") == lang_id).join(concepts_with_value(st, prop_id, value), "univ_id", "left_semi").select("univ_id", "page_id")


def points(st: DataFrame, prop_id: int = 625) -> DataFrame:
    """(item_id, lon, lat): the first coordinate of each item on earth, by statement id."""
    g = st.where((F.col("prop_id") == prop_id) & (F.col("val_type") == "OTHER"))
    x = lambda f: F.get_json_object("val_str", f"$.{f}").try_cast("double")
    globe = F.get_json_object("val_str", "$.globe")
    g = g.where(globe.isNull() | globe.endswith("/Q2")).select(F.col("entity_id").alias("item_id"), "id", x("longitude").alias("lon"), x("latitude").alias("lat")).where("lon is not null and lat is not null")
    return g.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("id"))).where("r = 1").select("item_id", "lon", "lat")
