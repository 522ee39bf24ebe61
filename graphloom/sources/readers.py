"""Readers for datasets, mapping files and web pages, and the converters between their shapes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import ship


def json_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, source_text_id, text) of one JSON object from samples to lists of passages; a file that is none is an error."""
    whole = spark.read.text(path, wholetext=True).select(_parsed("map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("sample_id", "texts")).select("sample_id", F.posexplode("texts").alias("pos", "text")).select("sample_id", F.col("pos").cast("string").alias("source_text_id"), "text")


def jsonl_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, source_text_id, text) of single-key objects, one a line; a sample's passages become one text, and a line that is none is an error."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.explode(_parsed("map<string,array<string>>")).alias("sample_id", "texts"))
    return rows.select("sample_id", F.lit("0").alias("source_text_id"), F.array_join("texts", "\n").alias("text"))


def _parsed(kind: str) -> Column:
    return F.coalesce(F.from_json("value", kind), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))


def keyed_questions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(id, question, answer and what else there is) of question records, which name their id ``id`` or ``_id``."""
    rows = records(spark, path, multiline)
    own = [F.col(c) for c in ("id", "_id") if c in rows.columns]
    if not own:
        raise ValueError(f"{path} has neither id nor _id")
    return rows.select(F.coalesce(*own).cast("string").alias("id"), *[c for c in rows.columns if c not in ("id", "_id")])


def records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A list of records (``multiline``) or one record a line."""
    return spark.read.option("multiLine", multiline).json(path)


def tolerant_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, json, corrupt) of objects that follow each other in any layout; a tail that does not parse is marked corrupt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, out = 0, []
                while True:
                    while at < len(text) and text[at] in " \t\r\n,":
                        at += 1
                    if at >= len(text):
                        break
                    try:
                        value, at = decoder.raw_decode(text, at)
                        out.append((json.dumps(value, ensure_ascii=False), False))
                    except json.JSONDecodeError:
                        out.append((text[at:], True))
                        break
                yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(out), pa.string()), "pos": pa.array(range(len(out)), pa.int32()), "json": pa.array([o[0] for o in out], pa.string()), "corrupt": pa.array([o[1] for o in out], pa.bool_())})

    ship(spark)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInArrow(run, "path string, pos int, json string, corrupt boolean")


def mapping(spark: SparkSession, path: str, value: str = "string", key_name: str = "id", value_name: str = "value") -> DataFrame:
    """(id, value) of a JSON map; ``value`` is the type of its values."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.explode("m").alias(key_name, value_name))


#: The eight mapping files of an ontology build and the types of their values (fixed values).
MAPPING_FILES = {
    "subj_constraint2prop": "array<string>",
    "obj_constraint2prop": "array<string>",
    "entity_type2label": "string",
    "entity_type2hierarchy": "array<string>",
    "entity_type2aliases": "array<string>",
    "prop2constraints": "struct<`Subject type constraint`:array<string>,`Value-type constraint`:array<string>>",
    "prop2label": "string",
    "prop2aliases": "array<string>",
}


def mappings(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: mapping(spark, f"{folder}/{name}.json", kind) for name, kind in MAPPING_FILES.items()}


def convert_musique(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("sample_id"), F.posexplode(F.transform("paragraphs", lambda p: p["paragraph_text"])).alias("pos", "text")).select("sample_id", F.col("pos").cast("string").alias("source_text_id"), "text")


def convert_hotpot(df: DataFrame) -> DataFrame:
    """``context``: array of structs (title, sentences)."""
    return df.select(F.col("_id").alias("sample_id"), F.posexplode(F.transform("context", lambda c: F.array_join(c["sentences"], " "))).alias("pos", "text")).select("sample_id", F.col("pos").cast("string").alias("source_text_id"), "text")


def convert_edgar(df: DataFrame, field: str = "original") -> DataFrame:
    """(filename, section, text) of every section but 1A and 1B; anything but a text is empty. ``sections``: map to struct."""
    rows = df.select("filename", F.explode("sections").alias("section", "s")).where(~F.col("section").isin("section_1A", "section_1B"))
    if df.where("filename IS NULL").limit(1).count():
        raise ValueError("a record has no filename")
    return rows.select("filename", "section", F.coalesce(F.col("s")[field], F.lit("")).alias("text"))


def convert_essays(df: DataFrame, key: str, content: str) -> DataFrame:
    """Passages of an essay: parts between blank lines, without the first."""
    parts = F.split(F.col(content), "\n\n")
    return df.select(F.col(key).cast("string").alias("sample_id"), F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 1))).alias("pos", "text")).where("text <> ''").select("sample_id", F.col("pos").cast("string").alias("source_text_id"), "text")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, paragraph, links): paragraphs before the first second-level heading, with the titles of their links."""
    body = F.regexp_replace(F.element_at(F.split("html", "(?i)<h2[ >]", 2), 1), "(?is)<(script|style)[^>]*>.*?</\\1>", "")
    raw = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit("(?is)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1))).alias("pos", "p"))
    text = F.trim(F.regexp_replace(F.regexp_replace("p", "<[^>]*>", " "), "\\s+", " "))
    links = F.filter(F.regexp_extract_all("p", F.lit("(?is)<a\\s[^>]*title=\"([^\"]*)\""), F.lit(1)), lambda t: t != "")
    return raw.select("page_id", "pos", text.alias("paragraph"), links.alias("links")).where("paragraph <> ''")


def entity_claims(triplets: DataFrame, entity: str, head: bool = True, entity_prefix: str = "http://www.wikidata.org/entity/", claim_prefix: str = "http://www.wikidata.org/prop/direct/") -> DataFrame:
    """One-hop claims of an entity as subject (``head``) or object; both ends must be entities and the predicate a direct claim."""
    side = "subject" if head else "object"
    rows = triplets.where((F.element_at(F.split(F.col(side), "/"), -1) == entity) & F.col("subject").startswith(entity_prefix) & F.col("object").startswith(entity_prefix) & F.col("relation").startswith(claim_prefix))
    return rows.select(*[F.element_at(F.split(F.col(c), "/"), -1).alias(c) for c in ("subject", "relation", "object")])


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, entity_id, content) of ``number:content`` lines; the id is the first letter-and-digits word."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).select(F.expr("try_cast(element_at(split(value, ':', 2), 1) AS bigint)").alias("line_no"), F.nullif(F.regexp_extract(parts[1], "([A-Za-z][0-9]+)", 1), F.lit("")).alias("entity_id"), parts[1].alias("content"))


@dataclass
class RunConfig:
    """Settings of a batch run; unknown keys are ignored and explicit nulls mean the default."""

    dataset: str = ""
    start: int = 0
    samples: int = 50
    structured: bool = True
    language: str = "en"
    hop_depth: int = 5
    rounds: int = 5
    candidates: int = 10
    dump: bool = False

    @classmethod
    def of(cls, values: dict) -> RunConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})


@dataclass
class QuestionConfig(RunConfig):
    """Settings of an evaluation run."""

    use_qualifiers: bool = True
    use_filtered: bool = False
    multi_step: bool = False
    run_number: int = 0

    def should_dump(self, store_is_local: bool) -> bool:
        """A dump is written where asked for, and where the store ends with the run."""
        return self.dump or store_is_local


def sample_slice(passages: DataFrame, order: str, start: int, n: int) -> DataFrame:
    """Passages of samples ``start`` to ``start + n`` in the order of their first appearance."""
    first = passages.groupBy("sample_id").agg(F.min(order).alias("_first")).orderBy("_first", "sample_id").limit(start + n)
    place = F.row_number().over(Window.orderBy("_first", "sample_id"))
    return passages.join(first.withColumn("_at", place).where(F.col("_at") > start).select("sample_id"), "sample_id", "left_semi")
