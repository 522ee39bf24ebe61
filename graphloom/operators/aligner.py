"""Look-ups of similar names and properties, and the aliases that make them findable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions.models import HashEmbedder
from graphloom.operators.refine import embedded
from graphloom.operators.tables import Catalog, stamp_sample
from graphloom.operators.vector import batch_top_k, distinct_top_k, prefix_length


def _ranked(asked: DataFrame, aliases: DataFrame, embedder: HashEmbedder, n: int, match: tuple[str, str] | None) -> DataFrame:
    vectors = embedded(asked, "name", embedder)
    queries = asked.join(vectors, "name").select("query_id", "embedding", *([match[0]] if match else []))
    keyed = aliases.withColumn("_alias_key", F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in ("alias", "label", "entity_type", "sample_id") if c in aliases.columns]))
    return batch_top_k(queries, keyed, n, "query_id", "embedding", "_alias_key", "alias_text_embedding", ["label", "alias"], match=match)


def similar_entity_names(asked: DataFrame, aliases: DataFrame, embedder: HashEmbedder = HashEmbedder(), k: int = 10, distinct: bool = False) -> DataFrame:
    """query_id, label, score, place: labels of the nearest aliases for each (query_id, name, sample_id).

    A name with a sample looks among that sample's aliases, one without among all. Without ``distinct`` a label comes as often as its
    aliases are near (structured ingestion); with it the k nearest labels come once each (dynamic ingestion).
    """
    n = prefix_length(k, "dynamic") if distinct else k
    parts = (asked.where("sample_id IS NOT NULL"), ("sample_id", "sample_id")), (asked.where("sample_id IS NULL"), None)
    ranked = None
    for rows, match in parts:
        found = _ranked(rows, aliases, embedder, n, match)
        ranked = found if ranked is None else ranked.unionByName(found)
    if distinct:
        return distinct_top_k(ranked, "label", k).select("query_id", "label", "score", "place")
    return ranked.select("query_id", "label", "score", F.col("rank").alias("place"))


def similar_properties(asked: DataFrame, aliases: DataFrame, embedder: HashEmbedder = HashEmbedder(), k: int = 10) -> DataFrame:
    """query_id, label, score, place: the k nearest distinct property labels for each (query_id, name); samples do not matter."""
    ranked = _ranked(asked.select("query_id", "name"), aliases, embedder, prefix_length(k, "dynamic"), None)
    return distinct_top_k(ranked, "label", k).select("query_id", "label", "score", "place")


def with_embeddings(aliases: DataFrame, embedder: HashEmbedder, text: str = "alias", vector: str = "alias_text_embedding") -> DataFrame:
    """Vectors where a row has none; a text is embedded once, and rows that have a vector keep it."""
    if vector not in aliases.columns:
        aliases = aliases.withColumn(vector, F.lit(None).cast("array<float>"))
    absent = F.col(vector).isNull() | (F.size(vector) == 0)
    made = embedded(aliases.where(absent), text, embedder, "_vector")
    return aliases.join(made, text, "left").withColumn(vector, F.when(absent, F.col("_vector")).otherwise(F.col(vector))).select(*aliases.columns)


def add_entities(catalog: Catalog, aliases: DataFrame, embedder: HashEmbedder = HashEmbedder(), sample_id: str | None = None) -> None:
    """Store entity aliases by key, the first of each; rows without a vector are embedded. In structured mode an empty sample is ``all``."""
    structured = catalog.mode == "structured"
    rows = aliases if sample_id is None and "sample_id" in aliases.columns else stamp_sample(aliases, sample_id, structured)
    if structured:
        rows = rows.withColumn("sample_id", F.coalesce(F.nullif("sample_id", F.lit("")), F.lit("all")))
    catalog.upsert("entity_aliases", with_embeddings(rows, embedder), schemas.KEYS[catalog.mode]["entity_aliases"])


def add_properties(catalog: Catalog, aliases: DataFrame, embedder: HashEmbedder = HashEmbedder()) -> None:
    """Store aliases of dynamic properties by key; rows without a vector are embedded."""
    catalog.upsert("property_aliases", with_embeddings(aliases, embedder), schemas.KEYS["dynamic"]["property_aliases"])


def cached_embeddings(texts: DataFrame, column: str, cache: DataFrame, embedder: HashEmbedder) -> tuple[DataFrame, DataFrame]:
    """((text, embedding) of the distinct texts, the cache with what it lacked). ``cache``: text, embedding; only unknown texts are embedded."""
    wanted = texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    made = embedded(wanted.join(cache.select("text"), "text", "left_anti"), "text", embedder)
    grown = cache.select("text", "embedding").unionByName(made)
    return grown.join(wanted, "text", "left_semi"), grown


def resize_vectors(catalog: Catalog, name: str, embedder: HashEmbedder, text: str = "alias", vector: str = "alias_text_embedding") -> None:
    """Embed a table's texts anew where another model has other dimensions; the rows stay."""
    rows = catalog.read(name).withColumn(vector, F.lit(None).cast("array<float>"))
    catalog.write(name, with_embeddings(rows, embedder, text, vector))
    catalog.ensure_vector_index(name, vector, embedder.dims)
