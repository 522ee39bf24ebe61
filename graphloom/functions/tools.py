"""The engine's tools as SQL functions of a session: scalar functions, and table functions over the views of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from graphloom.functions.models import Extractor
from graphloom.session import ship

_FACT = "subject STRING, relation STRING, object STRING, source_text_id STRING"

#: Table functions over the views triplets, entity_types, properties and entity_aliases.
TABLE_FUNCTIONS = {
    "supporting_triplets": ("entity STRING, sample STRING", _FACT, "SELECT subject, relation, object, source_text_id FROM triplets t WHERE (t.subject = entity OR t.object = entity) AND (sample IS NULL OR t.sample_id = sample)"),
    "entity_type_label": ("type_id STRING", "label STRING", "SELECT e.label FROM entity_types e WHERE e.entity_type_id = type_id"),
    "entity_type_ancestors": ("type_label STRING", "entity_type_id STRING", "SELECT DISTINCT explode(array_union(array(e.entity_type_id), e.parent_type_ids)) FROM entity_types e WHERE e.label = type_label"),
    "property_constraints": ("prop_id STRING", "label STRING, valid_subject_type_ids ARRAY<STRING>, valid_object_type_ids ARRAY<STRING>", "SELECT p.label, p.valid_subject_type_ids, p.valid_object_type_ids FROM properties p WHERE p.property_id = prop_id"),
    "entity_names": ("alias_name STRING, sample STRING", "label STRING", "SELECT DISTINCT a.label FROM entity_aliases a WHERE a.alias = alias_name AND (sample IS NULL OR a.sample_id = sample)"),
}
SCALAR_FUNCTIONS = {
    "is_none_answer": ("answer STRING", "BOOLEAN", r"coalesce(regexp_replace(answer, '[^\\w\\s]', '') = 'None', false)"),
    "fact_text": ("s STRING, r STRING, o STRING", "STRING", "concat_ws(', ', s, r, o)"),
}


def register_tools(spark: SparkSession, views: dict[str, DataFrame], extractor: Extractor | None = None) -> list[str]:
    """Create the views and the functions whose views are there; the names of the functions."""
    ship(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    made = []
    for name, (arguments, kind, body) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
        made.append(name)
    for name, (arguments, columns, body) in TABLE_FUNCTIONS.items():
        if any(f" {view} " in body for view in views):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
            made.append(name)
    if extractor is not None:

        class ExtractTriplets:
            def eval(self, text: str):
                for fact in extractor(text or ""):
                    yield fact["subject"], fact["relation"], fact["object"], fact["subject_type"], fact["object_type"]

        spark.udtf.register("extract_triplets", udtf(ExtractTriplets, returnType="subject string, relation string, object string, subject_type string, object_type string"))
        made.append("extract_triplets")
    return made
