"""Question answering over the graph, for whole tables of questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.models import Answerer, HashEmbedder, Stepper, question_entities
from graphloom.functions.text import exact_match, token_f1
from graphloom.operators.refine import embedded
from graphloom.operators.vector import batch_top_k, distinct_top_k, prefix_length
from graphloom.session import cut, ship, spread, stored


def _each(df: DataFrame, column: str, function: Callable, out: str, kind: str) -> DataFrame:
    """Add ``function`` of one column."""
    ship(df.sparkSession)
    at = df.columns.index(column)
    arrow = pa.list_(pa.string()) if kind.startswith("array") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([function(v) for v in batch.column(at).to_pylist()], arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{out} {kind}"]))


def link_entities(questions: DataFrame, names: DataFrame, embedder: HashEmbedder = HashEmbedder(), k: int = 10, least: float = 0.6, extractor: Callable[[str], list[str]] = question_entities) -> DataFrame:
    """(question_id, name): names of the graph that a question speaks of; exact ones, else the nearest if near enough.

    ``questions``: question_id, question. ``names``: name, embedding.
    """
    mentions = cut(_each(questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")), "question", extractor, "m", "array<string>").select("question_id", F.explode("m").alias("mention")).distinct())
    exact = mentions.join(names.select(F.col("name").alias("mention")).distinct(), "mention", "left_semi").select("question_id", F.col("mention").alias("name"))
    rest = mentions.join(names.select(F.col("name").alias("mention")).distinct(), "mention", "left_anti")
    ranked = batch_top_k(embedded(rest, "mention", embedder), names, prefix_length(k, "dynamic"), "mention", "embedding", "name", "embedding")
    near = distinct_top_k(ranked, "name", 1).where(F.col("score") >= least).select(F.col("query_id").alias("mention"), "name")
    return exact.union(rest.join(near, "mention").select("question_id", "name")).distinct()


def k_hop_by_question(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(question_id, subject, relation, object, source_text_id) within ``depth`` rounds of each question's seeds."""
    rows = edges.select("subject", "relation", "object", "source_text_id")
    frontier = cut(seeds.select("question_id", "name").distinct())
    visited, found = frontier, None
    for step in range(depth):
        touching = rows.join(frontier.withColumnRenamed("name", "subject"), "subject").select("question_id", *rows.columns)
        touching = touching.union(rows.join(frontier.withColumnRenamed("name", "object"), "object").select("question_id", *rows.columns))
        if step + 1 == depth:  # the last round's facts are read once, so they are not written
            found = touching if found is None else found.union(touching)
            break
        facts = cut(touching.distinct())
        found = facts if found is None else found.union(facts)
        ends = facts.select("question_id", F.col("subject").alias("name")).union(facts.select("question_id", "object")).distinct()
        frontier = cut(ends.join(visited, ["question_id", "name"], "left_anti"))
        if not frontier.limit(1).count():
            break
        visited = cut(visited.union(frontier))
    # Dealt by question, as whoever reads the facts of a question will have them.
    return found.repartition("question_id").distinct()


#: Facts that an answerer is shown: it reads them at once, so a question about a hub of the graph needs a bound.
MOST_FACTS = 10_000


def nearest_facts(questions: DataFrame, support: DataFrame, most: int) -> DataFrame:
    """Each question's distinct facts; of more than ``most`` those that share most words with the question, then by text."""
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))
    facts = support.select("question_id", "subject", "relation", "object").repartition("question_id").distinct()
    asked = questions.select("question_id", words("question").alias("_words"))
    shared = F.size(F.array_intersect(words(F.concat_ws(" ", "subject", "relation", "object")), "_words"))
    rated = facts.join(asked, "question_id").withColumn("_shared", shared)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("_shared"), "subject", "relation", "object"))
    return rated.withColumn("_place", place).where(F.col("_place") <= most).select("question_id", "subject", "relation", "object")


def answer(questions: DataFrame, support: DataFrame, answerer: Answerer, most: int = MOST_FACTS) -> DataFrame:
    """(question_id, question, answer); a question without support has no answer. The answerer sees at most ``most`` facts, the nearest."""
    ship(questions.sparkSession)
    facts = nearest_facts(questions, support, most)
    facts = facts.groupBy("question_id").agg(F.sort_array(F.collect_set(F.struct("subject", "relation", "object"))).alias("facts"))
    held = questions.select("question_id", "question").join(facts, "question_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [answerer(q or "", [(f["subject"], f["relation"], f["object"]) for f in facts or []]) for q, facts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["question_id", "question", "answer"])

    return held.mapInArrow(run, f"question_id {held.schema['question_id'].dataType.simpleString()}, question string, answer string")


def answer_questions(questions: DataFrame, edges: DataFrame, names: DataFrame, answerer: Answerer, embedder: HashEmbedder = HashEmbedder(), depth: int = 5, filtered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(support, answers): entities are linked, their neighbourhood is read, and the answerer sees that alone."""
    rows = edges if filtered is None else edges.unionByName(filtered, allowMissingColumns=True)
    spread(questions, rows)
    # Questions of one wording have one support and one answer. The support is not stored: it holds a fact once for each question.
    worded = questions.withColumn("_text", F.coalesce("question", F.lit("")))
    asked = stored(worded.select(F.col("_text").alias("question_id")).distinct(), "asked").select("question_id", F.col("question_id").alias("question"))
    support = k_hop_by_question(rows, link_entities(asked, names, embedder), depth)
    said = answer(asked, support, answerer).select(F.col("question_id").alias("_text"), "answer")
    own = worded.select(F.col("question_id").alias("_id"), "_text").join(support.withColumnRenamed("question_id", "_text"), "_text").drop("_text").withColumnRenamed("_id", "question_id")
    return own, worded.join(said, "_text", "left").select("question_id", "question", "answer")


def answer_by_collapsing(questions: DataFrame, edges: DataFrame, names: DataFrame, answerer: Answerer, decompose: Callable[[str], list[str]], embedder: HashEmbedder = HashEmbedder(), rounds: int = 5) -> DataFrame:
    """Multi-step answers: each round answers the next sub-question of every open question and puts the answer in place of ``#n``.

    ``decompose`` splits a question into sub-questions; ``#1`` stands for the first answer, and so on.
    """
    steps = cut(_each(questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")), "question", decompose, "steps", "array<string>").withColumn("answer", F.lit(None).cast("string")))
    for n in range(rounds):
        turn = steps.where(F.size("steps") > n).select("question_id", F.element_at("steps", n + 1).alias("question"))
        if not turn.limit(1).count():
            break
        linked = link_entities(turn, names, embedder)
        said = answer(turn, k_hop_by_question(edges, linked, 1), answerer).select("question_id", F.col("answer").alias("_said"))
        joined = steps.join(said, "question_id", "left")
        mark = F.lit(f"#{n + 1}")
        filled = F.when(F.col("_said").isNotNull(), F.transform("steps", lambda s: F.replace(s, mark, F.col("_said")))).otherwise(F.col("steps"))
        steps = cut(joined.select("question_id", "question", filled.alias("steps"), F.when(F.size("steps") > n, F.col("_said")).otherwise(F.col("answer")).alias("answer")))
    return steps.select("question_id", "question", "answer")


def answer_by_steps(questions: DataFrame, edges: DataFrame, names: DataFrame, answerer: Answerer, stepper: Stepper, embedder: HashEmbedder = HashEmbedder(), rounds: int = 5, k: int = 10) -> DataFrame:
    """(question_id, question, answer, asked, answers): multi-step answers, all open questions of a round at once.

    A round takes each open question's current step, links its entities and the answer before, reads one hop around them, and answers.
    Where that settles the question the final answer is kept and the question closed; otherwise the step is rewritten with the answer. A
    question that stays open keeps the answer of its last round.
    """
    ship(questions.sparkSession)
    kind = questions.schema["question_id"].dataType.simpleString()
    shape = f"question_id {kind}, question string, step string, asked array<string>, answers array<string>, final string"

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [q or "" for q in batch.column(1).to_pylist()]
            empty = pa.array([[] for _ in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([stepper.decompose(q) for q in texts], pa.string()), empty, empty, pa.nulls(len(texts), pa.string())], names=["question_id", "question", "step", "asked", "answers", "final"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                asked, answers = [*r["asked"], r["step"]], [*r["answers"], r["said"]]
                final = stepper.settled(r["question"], asked, answers)
                step = r["step"] if final is not None else stepper.collapse(r["question"], r["step"], r["said"])
                rows.append((r["question_id"], r["question"], step, asked, answers, final))
            types = [batch.schema.field("question_id").type, pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["question_id", "question", "step", "asked", "answers", "final"])

    state = cut(questions.select("question_id", "question").mapInArrow(opened, shape))
    for _ in range(rounds):
        turn = state.where("final IS NULL").select("question_id", F.col("step").alias("question"), F.get("answers", F.size("answers") - 1).alias("before"))
        if turn.isEmpty():
            break
        linked = link_entities(turn, names, embedder, k).union(turn.select("question_id", F.col("before").alias("name")).where("name IS NOT NULL")).distinct()
        said = answer(turn, k_hop_by_question(edges, linked, 1), answerer).select("question_id", F.col("answer").alias("said"))
        state = cut(state.where("final IS NULL").join(said, "question_id", "left").mapInArrow(judged, shape).union(state.where("final IS NOT NULL")))
    return state.select("question_id", "question", F.coalesce("final", F.get("answers", F.size("answers") - 1)).alias("answer"), "asked", "answers")


def score_answers(answers: DataFrame, truths: DataFrame) -> DataFrame:
    """Answers with their exact match and token F1; questions without a truth are left out."""
    return answers.join(truths, "question_id").withColumn("exact", exact_match(F.coalesce("answer", F.lit("")), F.col("truth"))).withColumn("f1", token_f1(F.coalesce("answer", F.lit("")), F.col("truth")))
