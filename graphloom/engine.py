"""One object that binds a catalog, the models and, where there is one, an ontology, with the tools that an agent would call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions.models import Answerer, Chooser, Extractor, HashEmbedder, SimilarityChooser
from graphloom.operators import aligner, graph, qa, refine
from graphloom.operators.tables import Catalog, stamp_sample


@dataclass
class Engine:
    """Ingestion and question answering over one catalog; with an ontology facts are typed and validated."""

    catalog: Catalog
    extractor: Extractor
    answerer: Answerer
    ontology: refine.Ontology | None = None
    embedder: HashEmbedder = HashEmbedder()
    chooser: Chooser = SimilarityChooser()

    @property
    def structured(self) -> bool:
        return self.ontology is not None

    def _passages(self, text: str, sample_id: str | None, source_text_id: str | None) -> DataFrame:
        spark = self.catalog.spark
        rows = spark.createDataFrame([(text, source_text_id)], "text string, source_text_id string")
        return stamp_sample(rows, sample_id, self.structured)

    def extract(self, passages: DataFrame) -> dict[str, DataFrame]:
        """The routed tables of (sample_id, source_text_id, text); nothing is stored."""
        aliases = self.catalog.read("entity_aliases")
        if self.structured:
            return refine.ingest_structured(passages, self.extractor, self.ontology, aliases)
        return refine.ingest_dynamic(passages, self.extractor, aliases, self.catalog.read("property_aliases"), self.embedder, self.chooser)

    def extract_and_store(self, passages: DataFrame) -> dict[str, DataFrame]:
        """Extract, upsert every table by key, and store the names of the accepted facts as aliases."""
        routed = self.extract(passages)
        key = schemas.KEYS[self.catalog.mode]["triplets"]
        for name, rows in routed.items():
            if self.catalog.exists(name):
                order = F.struct("sample_id", "source_text_id", "seq")
                self.catalog.upsert(name, rows.withColumn("_order", order).drop("seq"), key if name != "filtered_triplets" else [*key, "source_text_id"], "_order")
        facts = routed["triplets"]
        sides = [facts.select(F.col(c).alias("label"), F.col(c).alias("alias"), "sample_id", *([F.col(f"{c}_type").alias("entity_type")] if self.structured else [])) for c in ("subject", "object")]
        aligner.add_entities(self.catalog, sides[0].unionByName(sides[1]).where("alias IS NOT NULL").distinct(), self.embedder)
        if not self.structured:
            relations = facts.select(F.col("relation").alias("label"), F.col("relation").alias("alias")).where("alias IS NOT NULL").distinct()
            aligner.add_properties(self.catalog, relations, self.embedder)
        return routed

    def similar_names(self, name: str, k: int = 10, sample_id: str | None = None) -> list[str]:
        """At most k labels (with repeats in structured mode)."""
        asked = self.catalog.spark.createDataFrame([(0, name, sample_id)], "query_id int, name string, sample_id string")
        found = aligner.similar_entity_names(asked, self.catalog.read("entity_aliases"), self.embedder, k, distinct=not self.structured)
        return [r.label for r in found.orderBy("place").collect()]  # k rows

    def _names(self, sample_id: str | None) -> DataFrame:
        rows = graph.scoped(self.catalog.read("entity_aliases"), sample_id)
        return rows.groupBy(F.col("label").alias("name")).agg(F.min_by("alias_text_embedding", "alias").alias("embedding"))

    def relevant_entities(self, question: str, sample_id: str | None = None) -> list[str]:
        asked = self.catalog.spark.createDataFrame([(0, question)], "question_id int, question string")
        return sorted(r.name for r in qa.link_entities(asked, self._names(sample_id), self.embedder).collect())  # a few names for one question

    def one_hop(self, entities: list[str], sample_id: str | None = None, filtered: bool = False) -> DataFrame:
        names = self.catalog.spark.createDataFrame([(e,) for e in entities], "name string")
        more = self.catalog.read("ontology_filtered_triplets") if filtered and self.structured else None
        return graph.one_hop(self.catalog.read("triplets"), names, sample_id=sample_id, filtered=more)

    def answer(self, question: str, sample_id: str | None = None, depth: int = 5) -> str | None:
        asked = self.catalog.spark.createDataFrame([(0, question)], "question_id int, question string")
        edges = graph.scoped(self.catalog.read("triplets"), sample_id)
        return qa.answer_questions(asked, edges, self._names(sample_id), self.answerer, self.embedder, depth)[1].first()["answer"]

    def tools(self) -> dict[str, Callable]:
        """The six tools of the mode, each taking plain values."""
        extract = "extract_triplets_with_ontology_filtering" if self.structured else "extract_triplets"
        return {
            extract: lambda text, sample_id=None, source_text_id=None: self.extract(self._passages(text, sample_id, source_text_id)),
            f"{extract}_and_add_to_db": lambda text, sample_id=None, source_text_id=None: self.extract_and_store(self._passages(text, sample_id, source_text_id)),
            "retrieve_similar_entity_names": self.similar_names,
            "identify_relevant_entities_from_question": self.relevant_entities,
            "get_1_hop_supporting_triplets": self.one_hop,
            "answer_question": self.answer,
        }
