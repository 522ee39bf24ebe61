"""Ontology tables: assembly, inverted constraints, hierarchies, candidate properties and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Types that stand for times and quantities (fixed values).
TIME_TYPE, QUANTITY_TYPE, ANY = "Q186408", "Q309314", "ANY"
#: Han, kana and full-width characters (fixed values).
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿＀-￯]"


def sorted_set(column: Column | str) -> Column:
    return F.array_sort(F.collect_set(column))


def data_type_bucket(data_type: Column) -> Column:
    """item, quantity or time; other kinds are null."""
    kind = F.lower(F.element_at(F.split(data_type, "[#/]"), -1))
    return F.when(kind.contains("item"), "item").when(kind.contains("quantity"), "quantity").when(kind.contains("time"), "time")


def constraint_defaults(types: Column, bucket: Column) -> Column:
    """Append the time or quantity type for such properties; a list that stays empty is unconstrained."""
    added = F.when(bucket == "time", F.array_append(types, TIME_TYPE)).when(bucket == "quantity", F.array_append(types, QUANTITY_TYPE)).otherwise(types)
    return F.when(F.size(added) == 0, F.array(F.lit(ANY))).otherwise(added)


def invert_constraints(properties: DataFrame, column: str) -> DataFrame:
    """(entity_type_id, property_ids): from each property's types to each type's properties.

    A property with a time or quantity type goes to that bucket alone.
    """
    types = F.col(column)
    bucket = F.when(F.array_contains(types, TIME_TYPE), F.array(F.lit(TIME_TYPE))).when(F.array_contains(types, QUANTITY_TYPE), F.array(F.lit(QUANTITY_TYPE))).otherwise(types)
    return properties.select("property_id", F.explode(bucket).alias("entity_type_id")).groupBy("entity_type_id").agg(sorted_set("property_id").alias("property_ids"))


def build_entity_types(labels: DataFrame, parents: DataFrame, subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """Labels with their hierarchy (required) and the properties valid on either side (default: none)."""
    none = F.array().cast("array<string>")
    return (
        labels.join(parents, "entity_type_id")
        .join(subjects.withColumnRenamed("property_ids", "s"), "entity_type_id", "left")
        .join(objects.withColumnRenamed("property_ids", "o"), "entity_type_id", "left")
        .select("entity_type_id", "label", "parent_type_ids", F.coalesce("s", none).alias("valid_subject_property_ids"), F.coalesce("o", none).alias("valid_object_property_ids"))
    )


def build_properties(labels: DataFrame, constraints: DataFrame) -> DataFrame:
    return labels.join(constraints, "property_id").select("property_id", "label", "valid_subject_type_ids", "valid_object_type_ids")


def build_alias_rows(labels: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, alias_label): the label itself and every alias, for ids that the alias map holds."""
    own = labels.join(aliases.select(key).distinct(), key, "left_semi").select(key, F.col("label").alias("alias_label"))
    return own.union(aliases.join(labels.select(key), key, "left_semi").select(key, F.explode("aliases")))


def without_cjk(aliases: DataFrame, column: str) -> DataFrame:
    return aliases.where(~F.col(column).rlike(CJK))


def labelled_only(rows: DataFrame, ids: DataFrame, column: str, id_column: str) -> DataFrame:
    """Keep the labelled members of an array column; ANY and the special types stay, arrays may become empty."""
    special = F.array(*map(F.lit, (ANY, TIME_TYPE, QUANTITY_TYPE)))
    members = rows.select("_row", F.posexplode(column).alias("_pos", "_id")).join(ids.select(F.col(id_column).alias("_known")).distinct(), F.col("_id") == F.col("_known"), "left")
    kept = members.where(F.col("_known").isNotNull() | F.array_contains(special, F.col("_id"))).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_k"))
    return rows.join(kept, "_row", "left").withColumn(column, F.coalesce(F.transform("_k", lambda x: x["_id"]), F.array().cast("array<string>"))).drop("_k")


def constrained_entities(properties: DataFrame) -> DataFrame:
    """Sorted distinct ids that constraints name."""
    both = F.concat("valid_subject_type_ids", "valid_object_type_ids")
    return properties.select(F.explode(both).alias("entity_type_id")).where(F.col("entity_type_id") != ANY).distinct().orderBy("entity_type_id")


def disambiguate_labels(rows: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """Labels that several ids share get their description in brackets, where there is one."""
    shared = rows.groupBy("label").agg(F.count_distinct(key).alias("n")).where("n > 1").select("label", F.lit(True).alias("shared"))
    return rows.join(shared, "label", "left").join(descriptions, key, "left").select(key, F.when(F.col("shared") & F.col("description").isNotNull(), F.concat("label", F.lit(" ("), "description", F.lit(")"))).otherwise(F.col("label")).alias("label"))


def numeric_id_order(column: str) -> list[Column]:
    return [F.expr(f"try_cast(substring(`{column}`, 2) AS bigint)"), F.col(column)]


def retrieve_labels(ids: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ids with the named columns; unknown ids vanish."""
    return ids.join(table.select(key, *columns), key)


def type_hierarchy(types: DataFrame) -> DataFrame:
    """(label, entity_type_id, ancestor_id): the type itself and its parents that exist."""
    known = types.select(F.col("entity_type_id").alias("ancestor_id"))
    up = types.select("label", "entity_type_id", F.explode(F.array_union(F.array("entity_type_id"), "parent_type_ids")).alias("ancestor_id"))
    return up.join(known, "ancestor_id", "left_semi").select("label", "entity_type_id", "ancestor_id").distinct()


def valid_properties(types: DataFrame) -> DataFrame:
    """(entity_type_id, as_subject, as_object): properties valid for the type, ANY or an ancestor, sorted."""
    up = types.select("entity_type_id", F.explode(F.array_distinct(F.concat(F.array("entity_type_id", F.lit(ANY)), "parent_type_ids"))).alias("via"))
    own = types.select(F.col("entity_type_id").alias("via"), "valid_subject_property_ids", "valid_object_property_ids")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return up.join(own, "via").groupBy("entity_type_id").agg(union("valid_subject_property_ids").alias("as_subject"), union("valid_object_property_ids").alias("as_object"))


def candidate_properties(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """(subject_type, object_type, property_id, direction) for pairs of type ids: direct, or inverse with the sides swapped."""
    s = valid.select(F.col("entity_type_id").alias("subject_type"), F.col("as_subject").alias("ss"), F.col("as_object").alias("so"))
    o = valid.select(F.col("entity_type_id").alias("object_type"), F.col("as_subject").alias("os"), F.col("as_object").alias("oo"))
    both = pairs.join(s, "subject_type").join(o, "object_type")
    direct = both.select("subject_type", "object_type", F.explode(F.array_intersect("ss", "oo")).alias("property_id"), F.lit("direct").alias("direction"))
    return direct.union(both.select("subject_type", "object_type", F.explode(F.array_intersect("os", "so")).alias("property_id"), F.lit("inverse").alias("direction")))


def orient(df: DataFrame, direction: str = "direction") -> DataFrame:
    """Swap subject and object, with their types, where the direction is inverse."""
    inverse = F.col(direction) == "inverse"
    swaps = {}
    for a, b in (("subject", "object"), ("subject_type", "object_type"), ("subject_type_id", "object_type_id")):
        if a in df.columns and b in df.columns:
            swaps[a], swaps[b] = F.when(inverse, F.col(b)).otherwise(F.col(a)), F.when(inverse, F.col(a)).otherwise(F.col(b))
    return df.withColumns(swaps)


def _allows(valid: Column, ancestors: Column) -> Column:
    """Only a list that is exactly ANY is unconstrained; an empty one allows nothing."""
    return (valid == F.array(F.lit(ANY))) | F.arrays_overlap(valid, ancestors)


def validate_backbone(df: DataFrame) -> DataFrame:
    """Add ``valid`` and ``exception_text``.

    Needs subject_type_id, object_type_id, property_id, the property's valid type lists and both sides' ancestor lists; missing ids are
    reported together, otherwise a violated side is named.
    """
    missing = F.concat_ws("\n", *[F.when(F.col(c).isNull(), F.lit(f"{what} is not in the ontology")) for c, what in (("subject_type_id", "subject type"), ("object_type_id", "object type"), ("property_id", "relation"))])
    sides = [F.coalesce(_allows(F.col(f"valid_{s}_type_ids"), F.col(f"{s}_ancestors")), F.lit(False)) for s in ("subject", "object")]
    broken = F.concat_ws("\n", *[F.when(~ok, F.lit(f"{s} type violates the constraint")) for s, ok in zip(("subject", "object"), sides, strict=True)])
    text = F.when(missing != "", missing).otherwise(broken)
    return df.withColumn("exception_text", text).withColumn("valid", F.col("exception_text") == "")


def transitive_closure(edges: DataFrame, parent: str = "parent", child: str = "child", most_rounds: int = 40) -> DataFrame:
    """(child, ancestor) over the edges, reflexive; paths double in length every round."""
    pairs = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"))
    nodes = pairs.select("child").union(pairs.select("ancestor")).distinct()
    closure, n = cut(pairs.union(nodes.select("child", F.col("child").alias("ancestor"))).distinct()), -1
    for _ in range(most_rounds):
        count = closure.count()
        if count == n:
            return closure
        n = count
        step = closure.alias("a").join(closure.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"))
        closure = cut(step.distinct())
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def constraint_summary(properties: DataFrame) -> DataFrame:
    free = (F.col("valid_subject_type_ids") == F.array(F.lit(ANY))) & (F.col("valid_object_type_ids") == F.array(F.lit(ANY)))
    return properties.agg(F.count(F.lit(1)).alias("properties"), F.count_if(free).alias("unconstrained"), F.count_distinct("label").alias("labels"))
