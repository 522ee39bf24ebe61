"""Ontology sources and SQL tools."""

from graphloom.functions import models, tools
from graphloom.sources import fixtures, ontology_source

WD = "http://example.org/entity/"


def test_ontology_from_bindings(spark):
    meta = ontology_source.property_metadata(spark.createDataFrame([(WD + "P1", "http://x#WikibaseItem", "in", "inside", "en"), (WD + "P1", "http://x#WikibaseItem", "in", "within", "en"), (WD + "P2", "http://x#Time", "when", None, "en"), (WD + "P3", "http://x#String", "s", None, "en"), (WD + "P4", "http://x#WikibaseItem", " ", None, "en")], "property string, data_type string, label string, alias string, lang string"))
    assert {r.property_id: (r.label, r.bucket, r.aliases) for r in meta.collect()} == {"P1": ("in", "item", ["inside", "within"]), "P2": ("when", "time", [])}
    bound = ontology_source.property_constraints(spark.createDataFrame([(WD + "P1", WD + "Q21503250", WD + "Q5"), (WD + "P1", WD + "Q21510865", WD + "Q6")], "property string, constraint string, type string"), meta)
    assert {r.property_id: (r.valid_subject_type_ids, r.valid_object_type_ids) for r in bound.collect()} == {"P1": (["Q5"], ["Q6"]), "P2": (["ANY"], ["Q186408"])}
    ids = spark.createDataFrame([(i,) for i in ("a", "d", "x", "i", "z")], "entity_type_id string")
    up = ontology_source.entity_hierarchy(ids, spark.createDataFrame([("i", "a")], "child string, parent string"), spark.createDataFrame(fixtures.SUBCLASS_EDGES, "child string, parent string"))
    assert {r.entity_type_id: r.parent_type_ids for r in up.collect()} == {"a": ["a", "d", "x"], "d": ["d"], "x": ["d", "x"], "i": ["a", "d", "i", "x"], "z": ["z"]}
    names = spark.createDataFrame([(WD + "Q1", "one", None, "eins", "en"), (WD + "Q1", "one", None, "一", "en"), (WD + "Q2", "zwei", "d", "x", "de")], "entity string, label string, description string, alias string, lang string")
    assert [tuple(r) for r in ontology_source.labels_and_descriptions(names, "id").collect()] == [("Q1", "one", None)]
    assert [tuple(r) for r in ontology_source.entity_aliases(names, "id").collect()] == [("Q1", ["eins"])]
    raw = spark.createDataFrame([('{"P31":[{"id":"Q5"},{"id":"Q7"}],"P50":[{"id":"Q9"}],"P279":[{"id":"Q5"}]}',)], "j string")
    assert raw.select(ontology_source.claimed_ids("j").alias("c")).first().c == ["Q5", "Q7"]


def test_tools(spark, sf):
    types, properties = fixtures.ontology(spark)
    made = tools.register_tools(spark, {"triplets": fixtures.triplets(spark, sf), "entity_types": types, "properties": properties}, models.PatternExtractor())
    assert {"supporting_triplets", "entity_type_ancestors", "property_constraints", "extract_triplets"} <= set(made) and "entity_names" not in made
    assert spark.sql("SELECT * FROM supporting_triplets('NATION_3', NULL)").count() > 0
    assert {r[0] for r in spark.sql("SELECT * FROM entity_type_ancestors('customer')").collect()} == {"E1", "E7"}
    assert spark.sql("SELECT is_none_answer('None.') AS a, fact_text('s', 'r', 'o') AS b").first() == (True, "s, r, o")
    assert spark.sql("SELECT subject, object FROM extract_triplets('Paris is located in France.')").first() == ("Paris", "France")
