"""What larger inputs brought to light: each test fails on the code before its finding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.functions import models, text
from graphloom.operators import components, graph, qa, refine, tables, vector
from graphloom.sources import fixtures


def test_sentences_keep_the_digits_of_their_place(spark):
    df = spark.createDataFrame([(1, "One. 1 is 1. 28.68.191.23 is it. 3")], "k int, t string")
    assert text.chunk_fixed(df, "k", "t").first().chunk == "One. 1 is 1. 28.68.191.23 is it. 3"
    assert df.select(text.split_sentences(F.col("t")).alias("s")).first().s == ["One.", "1 is 1.", "28.68.191.23 is it.", "3"]


def test_names_of_the_same_grams_in_another_order_stay_apart(spark):
    names = ["Customer#000001000", "Customer#000010000", "Customer#000010001", "Customer#000100001"]
    vectors = np.array(models.HashEmbedder()(names))
    assert (vectors @ vectors.T - np.eye(4)).max() < 0.995
    facts = spark.createDataFrame([(n, "located in country", "CHINA", "customer", "country", [], "ASIA", str(i), i) for i, n in enumerate(names)], "subject string, relation string, object string, subject_type string, object_type string, qualifiers array<struct<relation:string,object:string>>, sample_id string, source_text_id string, seq long")
    aliases = spark.createDataFrame([], "sample_id string, entity_type string, label string, alias string")
    out = refine.refine_names(facts, aliases, models.HashEmbedder(), models.SimilarityChooser(least=0.9999))
    assert sorted(r.subject for r in out.collect()) == names


@pytest.mark.parametrize("few", [0, 500, 1 << 20])
def test_components_by_contraction(spark, few, monkeypatch):
    """A path, a star and loops, in two samples; no round may leave a node that all others of its component meet in."""
    import random

    monkeypatch.setattr(components, "FEW_EDGES", few)
    draw = random.Random(1)
    path = [(f"p{i}", f"p{i + 1}") for i in range(200)]
    star = [("hub", f"leaf{i}") for i in range(300)]
    odd = [(f"x{draw.randrange(80)}", f"x{draw.randrange(80)}") for _ in range(60)] + [("alone", "alone")]
    edges = path + star + odd
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(s, a, b) for s in ("A", "B") for a, b in edges] + [("B", "p0", "hub"), (None, "p", "q"), ("A", None, "q")], "sample_id string, subject string, object string")
    found = graph.components(df.where("sample_id = 'A'"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in parent}
    assert {r.sample_id: r.largest_component for r in graph.sample_components(df).collect()} == {"A": 301, "B": 502}
    links, _, _ = components.numbered(df, "subject", "object")
    assert components.roots(links).where("id <> root").count() > 0


@pytest.mark.parametrize("few", [500_000, 4])
def test_named_components_take_no_rounds_for_few_edges(spark, few, monkeypatch):
    """A long chain, a star and a circle of copied links; each round is several shuffles (op1_near_dedup was stopped on check_h)."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    steps = []
    for name in ("cut", "stored"):
        monkeypatch.setattr(components, name, lambda df, *a, f=getattr(components, name): steps.append(1) or f(df, *a))
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(60)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)] * 2 + [(7, 7), (400, 400), (None, 3)]
    found = [(r.node, r.component) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()]
    wanted = [(i, 0) for i in range(61)] + [(100, 100)] + [(200 + i, 100) for i in range(60)] + [(300 + i, 300) for i in range(20)]
    assert sorted(found) == wanted
    assert len(steps) == 2 or few == 4


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    """The number of shuffle partitions follows the stored input, and is never lowered."""
    before, merged = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(session._MERGE_SETTING)
    try:
        spark.range(2000).withColumn("relation", F.lit("r")).selectExpr("cast(id as string) subject", "cast(id + 1 as string) object", "relation", "id seq").write.parquet(str(tmp_path / "e"))
        edges = spark.read.parquet(str(tmp_path / "e"))
        monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 8)
        assert graph.last_relation(edges).count() == 2000
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before)
        monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 30)
        graph.last_relation(edges)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before)
        assert spark.conf.get(session._MERGE_SETTING) == session.MERGED_BYTES
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(session._MERGE_SETTING, merged)


def test_triangles_of_a_random_graph(spark):
    import random
    from itertools import combinations

    draw = random.Random(5)
    edges = {(f"n{draw.randrange(25)}", f"n{draw.randrange(25)}") for _ in range(120)}
    near = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, set()).update({y} - {x})
    wanted = {x: 0 if len(n) < 2 else sum(b in near[a] for a, b in combinations(sorted(n), 2)) / (len(n) * (len(n) - 1) / 2) for x, n in near.items()}
    df = spark.createDataFrame([("S", a, b) for a, b in edges], "sample_id string, subject string, object string")
    found = {r.node: (r.degree, r.clustering) for r in graph.local_clustering(df, ["sample_id"]).collect()}
    assert {x: c for x, (_, c) in found.items()} == pytest.approx(wanted) and {x: d for x, (d, _) in found.items()} == {x: len(n) for x, n in near.items()}
    row = graph.statistics(df, ["sample_id"]).first()
    assert (row.sample_id, row.nodes, row.edges) == ("S", len(near), len(edges)) and row.clustering == pytest.approx(sum(wanted.values()) / len(wanted))


def test_stages_as_conditions_equal_stages_as_tables(spark, sf):
    """A row that is of three stages is shuffled once, not three times."""
    rows = {"initial_triplets": fixtures.initial_triplets, "triplets": fixtures.triplets, "filtered_triplets": fixtures.filtered_triplets, "ontology_filtered_triplets": fixtures.ontology_filtered_triplets}
    apart = {name: table(spark, sf) for name, table in rows.items()}
    stages, facts = fixtures.staged_facts(spark, sf)
    for dumped in (tables.dump_counts, tables.dump):
        assert sorted(map(tuple, dumped(stages, rows=facts).collect())) == sorted(map(tuple, dumped(apart).collect()))


def test_distinct_search_returns_few_rows_and_the_same_labels(spark, monkeypatch):
    draw = np.random.default_rng(7)
    vectors = [(i, "common" if i % 50 else f"l{i % 7}", [float(x) for x in draw.normal(size=8)]) for i in range(900)]
    table = spark.createDataFrame(vectors, "i int, label string, v array<double>")
    asked = table.where("i % 90 = 0").withColumnRenamed("v", "qv")
    whole = vector.distinct_top_k(vector.batch_top_k(asked, table, vector.prefix_length(5, "types"), "i", "qv", "i", "v", ["label"]), "label", 5)
    seen, search = [], vector.batch_top_k
    monkeypatch.setattr(vector, "batch_top_k", lambda queries, table, k, *a, **b: seen.append(k) or search(queries, table, k, *a, **b))
    found = vector.batch_distinct_top_k(asked, table, 5, "types", "i", "qv", "i", "v", "label")
    columns = ["query_id", "label", "first_rank", "score", "place"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert seen[0] == 40 and seen == sorted(seen) and len(seen) > 1
    monkeypatch.setattr(vector, "MOST_FOUND", 160)
    assert sorted(map(tuple, search(asked, table, 20, "i", "qv", "i", "v").select("query_id", "i", "rank").collect())) == sorted(map(tuple, search(asked, table, 40, "i", "qv", "i", "v").where("rank <= 20").select("query_id", "i", "rank").collect()))


def test_questions_of_one_wording_are_answered_once(spark):
    edges = spark.createDataFrame([("Ann", "knows", "Bob", "1"), ("Bob", "knows", "Cid", "2")], "subject string, relation string, object string, source_text_id string")
    names = refine.embedded(edges.select(F.col("subject").alias("name")).union(edges.select("object")), "name", models.HashEmbedder())
    asked = spark.createDataFrame([(1, "Whom does Ann know"), (2, "Whom does Ann know"), (3, None)], "question_id int, question string")
    support, answers = qa.answer_questions(asked, edges, names, models.OverlapAnswerer(), depth=1)
    assert {r.question_id: (r.question, r.answer) for r in answers.collect()} == {1: ("Whom does Ann know", "Bob"), 2: ("Whom does Ann know", "Bob"), 3: (None, None)}
    assert sorted((r.question_id, r.source_text_id) for r in support.collect()) == [(1, "1"), (2, "1")]
    assert any("/asked-" in f for f in answers.inputFiles())


@pytest.mark.parametrize("least", [0.7, 0.95])
def test_names_in_tiles_equal_a_plain_fold(spark, least, monkeypatch):
    """No task compares more than two tiles, whatever the size of a sample and type (ingest_structured_merging), null samples included."""
    from test_operators import plain_fold

    monkeypatch.setattr(refine, "VECTOR_ROW", 8)
    monkeypatch.setattr(refine, "TILE", 32)
    monkeypatch.setattr(refine, "SLICE", (4, 16))
    draw = np.random.default_rng(5)
    names = [f"Order#{n}" for n in draw.integers(1000, 1300, 500)] + ["ORDER#1001", "order#1001"] + [f"order#{'12' * n}" for n in range(3, 20)]
    facts = [("s" if i % 3 else "", f"{i:04d}", 0, n, "order", str(names[(7 * i) % len(names)]), "order") for i, n in enumerate(map(str, names))]
    df = spark.createDataFrame(facts, "sample_id string, source_text_id string, seq long, subject string, subject_type string, object string, object_type string").withColumn("sample_id", F.nullif("sample_id", F.lit("")))
    none = spark.createDataFrame([], "sample_id string, entity_type string, label string, alias string")
    chooser = models.SimilarityChooser(least=least)
    found = sorted((r.sample_id or "", r.source_text_id, r.subject, r.object) for r in refine.refine_names(df.repartition(5), none, models.HashEmbedder(), chooser).collect())
    wanted = plain_fold(facts, [], models.HashEmbedder(), chooser, True)
    assert found == wanted and len({w[2] for w in wanted}) < len({f[3] for f in facts})


def test_json_amid_prose_is_found_once(spark):
    texts = ["x {no} [1, {\"a\": [2]}] y [3]", "{a [}] {\"b\": 1} {\"c\": 2}", "[{]", "{\"a\": [1}", "say {\"k\": \"}\"} end", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(text.extract_json(F.col("t"))).collect()]
    assert found == ['[1, {"a": [2]}]', '{"b": 1}', "[{]", '{"a": [1}', '{"k": "}"}', "plain"]
