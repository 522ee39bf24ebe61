"""Files that runs leave behind: answers, mappings, summaries and preprocessed datasets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ontology import numeric_id_order
from graphloom.session import ship


def answers_name(store: str, model: str, **settings: object) -> str:
    """The folder name of one evaluation run, by its settings."""
    return "_".join([store, model.replace("/", "_"), *(f"{k}_{v}" for k, v in settings.items())])


def append_answers(answers: DataFrame, folder: str) -> None:
    """One JSON object a line for each answer, added to those that are there; an answer that is null is written as null."""
    answers.select(F.to_json(F.struct("sample_id", "answer"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(folder)


def write_object(rows: DataFrame, path: str) -> None:
    """One JSON object from (id, value), ids in the order given: a file of lines that one task streams.

    ``value`` may be of any type that has a JSON form.
    """
    ship(rows.sparkSession)
    body = F.to_json(F.struct(F.col("value"))).alias("json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            lines = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines.append(("{" if not n else ",") + json.dumps(key, ensure_ascii=False) + ":" + text[len('{"value":') : -1])
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["}" if n else "{}"], pa.string())], names=["value"])

    picked = rows.select(F.col("id").cast("string"), body)
    if picked.isEmpty():  # which may have no partition, and so no task
        lines = rows.sparkSession.createDataFrame([("{}",)], "value string")
    else:
        lines = picked.coalesce(1).mapInArrow(run, "value string")
    lines.write.mode("overwrite").text(path)


def write_mapping(rows: DataFrame, path: str) -> None:
    """A mapping file from (id, value), by the number in the id."""
    write_object(rows.where("value IS NOT NULL").orderBy(*numeric_id_order("id")), path)


def write_dataset(passages: DataFrame, path: str) -> None:
    """A dataset file from (sample_id, source_text_id, text): an object from samples to lists of passages in their order."""
    place = F.struct(F.expr("try_cast(source_text_id AS bigint)"), F.col("source_text_id"), F.col("text"))
    texts = passages.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]).alias("value"))
    write_object(texts.select(F.col("sample_id").alias("id"), "value").orderBy("id"), path)


def write_summary(maps: dict[str, DataFrame], unlabelled: dict[str, DataFrame], folder: str) -> DataFrame:
    """Lists of the ids left out for want of a label, and a text report with the size of each mapping; the report's lines as rows."""
    spark = next(iter(maps.values())).sparkSession
    lines = [f"{name}: {df.count()}" for name, df in maps.items()]
    lines += ["", "Items excluded due to missing labels"]
    for name, ids in unlabelled.items():
        (key,) = ids.columns
        ids.orderBy(*numeric_id_order(key)).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_without_label")
        lines.append(f"{name} without label: {ids.count()}")
    report = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    report.write.mode("overwrite").text(f"{folder}/summary_collected_mappings")
    return report
