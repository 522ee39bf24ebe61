"""Query results of an open ontology (bindings as rows) turned into the mapping tables that an ontology build reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import blank_to_null, uri_tail
from graphloom.operators.ontology import constraint_defaults, data_type_bucket, sorted_set, transitive_closure, without_cjk
from graphloom.session import cut

#: The two constraint classes that a build reads, by id (fixed values).
CONSTRAINTS = {"Q21503250": "valid_subject_type_ids", "Q21510865": "valid_object_type_ids"}


def property_metadata(bindings: DataFrame, language: str = "en") -> DataFrame:
    """(property_id, label, bucket, aliases) from rows of property, data_type, label, alias, lang; unlabelled properties are dropped."""
    rows = bindings.where(F.col("lang") == language).select(uri_tail(F.col("property")).alias("property_id"), blank_to_null(F.col("label")).alias("label"), data_type_bucket(F.col("data_type")).alias("bucket"), blank_to_null(F.col("alias")).alias("alias"))
    return rows.where("label IS NOT NULL AND bucket IS NOT NULL").groupBy("property_id").agg(F.min("label").alias("label"), F.min("bucket").alias("bucket"), sorted_set("alias").alias("aliases"))


def property_constraints(bindings: DataFrame, metadata: DataFrame) -> DataFrame:
    """(property_id, valid_subject_type_ids, valid_object_type_ids) from rows of property, constraint, type.

    Every property of ``metadata`` has a row: times and quantities get their type, lists that stay empty are unconstrained.
    """
    rows = bindings.select(uri_tail(F.col("property")).alias("property_id"), uri_tail(F.col("constraint")).alias("c"), uri_tail(F.col("type")).alias("t"))
    lists = rows.groupBy("property_id").pivot("c", list(CONSTRAINTS)).agg(sorted_set("t")).withColumnsRenamed(CONSTRAINTS)
    none = F.array().cast("array<string>")
    joined = metadata.select("property_id", "bucket").join(lists, "property_id", "left")
    subject = F.coalesce("valid_subject_type_ids", none)
    return joined.select(
        "property_id",
        F.when(F.size(subject) == 0, F.array(F.lit("ANY"))).otherwise(subject).alias("valid_subject_type_ids"),
        constraint_defaults(F.coalesce("valid_object_type_ids", none), F.col("bucket")).alias("valid_object_type_ids"),
    )


def entity_hierarchy(entities: DataFrame, instance_of: DataFrame, subclass_of: DataFrame) -> DataFrame:
    """(entity_type_id, parent_type_ids) of the entities: all classes above them, themselves and those of their kinds included.

    Edges are (child, parent); parents are restricted to the entities.
    """
    closure = cut(transitive_closure(subclass_of.select("child", "parent")))
    own = entities.select(F.col("entity_type_id").alias("child")).distinct()
    direct = own.join(closure, "child").union(own.select("child", F.col("child").alias("ancestor")))
    kinds = own.join(instance_of.select("child", F.col("parent").alias("kind")), "child")
    by_kind = kinds.join(closure.withColumnRenamed("child", "kind"), "kind").select("child", "ancestor").union(kinds.select("child", "kind"))
    known = own.select(F.col("child").alias("ancestor"))
    return direct.union(by_kind).distinct().join(known, "ancestor", "left_semi").groupBy(F.col("child").alias("entity_type_id")).agg(sorted_set("ancestor").alias("parent_type_ids"))


def labels_and_descriptions(bindings: DataFrame, key: str, language: str = "en") -> DataFrame:
    """(key, label, description) from rows of entity, label, description, lang; a missing description stays null."""
    rows = bindings.where(F.col("lang") == language).select(uri_tail(F.col("entity")).alias(key), blank_to_null(F.col("label")).alias("label"), blank_to_null(F.col("description")).alias("description"))
    return rows.where("label IS NOT NULL").groupBy(key).agg(F.min_by(F.struct("label", "description"), F.struct("label", "description")).alias("r")).select(key, "r.label", "r.description")


def entity_aliases(bindings: DataFrame, key: str, language: str = "en") -> DataFrame:
    """(key, aliases) from rows of entity, alias, lang, without names in Han, kana or full-width characters."""
    rows = bindings.where(F.col("lang") == language).select(uri_tail(F.col("entity")).alias(key), blank_to_null(F.col("alias")).alias("alias")).where("alias IS NOT NULL")
    return without_cjk(rows, "alias").groupBy(key).agg(sorted_set("alias").alias("aliases"))


def unlabelled(ids: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Ids that lack a label, for the summary of a build."""
    return ids.select(key).distinct().join(labels.select(key), key, "left_anti").orderBy(key)


def normalize_triplets(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Facts given as text triples in an array, or as columns, in one shape; the first ``most`` by text."""
    if "triple" in rows.columns:
        rows = rows.where(F.size("triple") == 3).select(*[F.col("triple")[i].alias(c) for i, c in enumerate(("subject", "relation", "object"))])
    return rows.select("subject", "relation", "object").na.drop(subset=["subject", "object"]).orderBy("subject", "relation", "object").limit(most)


def qualifier_key(label: str, description: str) -> F.Column:
    return F.replace(F.concat_ws("; ", label, description), F.lit("_"), F.lit(" "))


def claimed_ids(column: str, properties: tuple[str, ...] = ("P31", "P279")) -> F.Column:
    """Ids that raw entity JSON claims under the given properties."""
    blocks = F.regexp_extract_all(F.col(column), F.lit(rf'"(?:{"|".join(properties)})":\[(.*?)\](?=,"P|\}}|$)'), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'(?<="id":")([A-Z][0-9]+)(?=")'), F.lit(1)))))


def describe(ids: DataFrame, labels: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """(key, label, description) of ids, an id that has moved under that of its successor; unknown ids keep null.

    ``labels``: key, label, description, of which the first by label counts. ``redirects``: id, successor.
    """
    moved = redirects.groupBy(F.col("id").alias(key)).agg(F.min("successor").alias("_now"))
    found = labels.groupBy(F.col(key).alias("_now")).agg(F.min(F.struct("label", "description")).alias("_d"))
    now = ids.select(key).distinct().join(moved, key, "left").withColumn("_now", F.coalesce("_now", key))
    return now.join(found, "_now", "left").select(key, F.col("_d.label").alias("label"), F.col("_d.description").alias("description"))


def merge_descriptions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, description): what is new wins, what it lacks stays."""
    return new.where("description IS NOT NULL").select(key, "description").unionByName(old.select(key, "description").join(new.where("description IS NOT NULL"), key, "left_anti"))
