"""Schemas of the knowledge-graph tables and their keys."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())
_VECTOR = T.ArrayType(T.FloatType())
QUALIFIERS = T.ArrayType(T.StructType([T.StructField("relation", _S), T.StructField("object", _S)]))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TRIPLET = {"subject": _S, "relation": _S, "object": _S, "subject_type": _S, "object_type": _S, "qualifiers": QUALIFIERS, "sample_id": _S, "source_text_id": _S, "prompt_token_num": T.LongType(), "completion_token_num": T.LongType()}

SCHEMAS: dict[str, T.StructType] = {
    "entity_types": _struct(entity_type_id=_S, label=_S, parent_type_ids=_A, valid_subject_property_ids=_A, valid_object_property_ids=_A),
    "entity_type_aliases": _struct(entity_type_id=_S, alias_label=_S, alias_text_embedding=_VECTOR),
    "properties": _struct(property_id=_S, label=_S, valid_subject_type_ids=_A, valid_object_type_ids=_A),
    "property_aliases": _struct(relation_id=_S, alias_label=_S, alias_text_embedding=_VECTOR),
    "dynamic_property_aliases": _struct(label=_S, alias=_S, alias_text_embedding=_VECTOR),
    "entity_aliases": _struct(label=_S, entity_type=_S, alias=_S, sample_id=_S, alias_text_embedding=_VECTOR),
    "initial_triplets": _struct(**_TRIPLET),
    "triplets": _struct(**_TRIPLET),
    "filtered_triplets": _struct(**_TRIPLET, exception_text=_S),
    "ontology_filtered_triplets": _struct(**_TRIPLET, exception_text=_S),
}

#: Unique keys by mode; the structured triplet key knows the types, the dynamic one does not. Provenance is in neither.
KEYS: dict[str, dict[str, list[str]]] = {
    "structured": {"triplets": ["subject", "relation", "object", "subject_type", "object_type", "sample_id"], "entity_aliases": ["label", "entity_type", "alias", "sample_id"]},
    "dynamic": {"triplets": ["subject", "relation", "object", "sample_id"], "entity_aliases": ["label", "alias", "sample_id"], "property_aliases": ["label", "alias"]},
}
STAGES = ("initial_triplets", "triplets", "filtered_triplets", "ontology_filtered_triplets")
EXPORT_FIELDS = ("subject", "relation", "object", "subject_type", "object_type", "qualifiers", "sample_id", "source_text_id")
ONTOLOGY_TABLES = ("entity_types", "entity_type_aliases", "properties", "property_aliases")
MODE_TABLES = {"structured": (*STAGES, "entity_aliases"), "dynamic": ("initial_triplets", "triplets", "filtered_triplets", "entity_aliases", "property_aliases")}
