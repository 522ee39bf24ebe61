"""The ontology build: from the eight mapping tables to the four ontology tables of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions.models import HashEmbedder
from graphloom.operators.aligner import with_embeddings
from graphloom.operators.ontology import build_alias_rows, build_entity_types, build_properties
from graphloom.operators.tables import Catalog

_SUBJECT, _OBJECT = "Subject type constraint", "Value-type constraint"


def ontology_tables(maps: dict[str, DataFrame], embedder: HashEmbedder = HashEmbedder()) -> dict[str, DataFrame]:
    """The four tables. ``maps``: (id, value) by the names of the mapping files; types need a label and a hierarchy, properties a label and constraints."""
    part = lambda name, key, value: maps[name].select(F.col("id").alias(key), F.col("value").alias(value))
    type_labels, property_labels = part("entity_type2label", "entity_type_id", "label"), part("prop2label", "property_id", "label")
    none = F.array().cast("array<string>")
    constraints = maps["prop2constraints"].select(F.col("id").alias("property_id"), F.coalesce(F.col("value")[_SUBJECT], none).alias("valid_subject_type_ids"), F.coalesce(F.col("value")[_OBJECT], none).alias("valid_object_type_ids"))
    types = build_entity_types(
        type_labels,
        part("entity_type2hierarchy", "entity_type_id", "parent_type_ids"),
        part("subj_constraint2prop", "entity_type_id", "property_ids"),
        part("obj_constraint2prop", "entity_type_id", "property_ids"),
    )
    property_aliases = build_alias_rows(property_labels, part("prop2aliases", "property_id", "aliases"), "property_id").withColumnRenamed("property_id", "relation_id")
    return {
        "entity_types": types,
        "entity_type_aliases": with_embeddings(build_alias_rows(type_labels, part("entity_type2aliases", "entity_type_id", "aliases"), "entity_type_id"), embedder, "alias_label"),
        "properties": build_properties(property_labels, constraints),
        "property_aliases": with_embeddings(property_aliases, embedder, "alias_label"),
    }


def build_ontology(catalog: Catalog, maps: dict[str, DataFrame], embedder: HashEmbedder = HashEmbedder()) -> dict[str, int]:
    """Write the four tables anew and record their indexes; the number of rows of each."""
    keys = {"entity_types": "entity_type_id", "entity_type_aliases": "entity_type_id", "properties": "property_id", "property_aliases": "relation_id"}
    for name, df in ontology_tables(maps, embedder).items():
        catalog.drop(name)
        columns = [f.name for f in schemas.SCHEMAS[name].fields]
        catalog.write(name, df.select(*columns), [keys[name]])
        catalog.create_indexes(name, [keys[name]])
        if "alias_text_embedding" in columns:
            catalog.ensure_vector_index(name, "alias_text_embedding", embedder.dims)
    return {name: catalog.read(name).count() for name in schemas.ONTOLOGY_TABLES}
