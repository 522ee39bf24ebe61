"""Operators on small hand-made tables."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import models, text
from graphloom.operators import filters, graph, ontology, qa, refine, tables, vector
from graphloom.operators.components import connected_components
from graphloom.sources import fixtures, readers
from graphloom.streaming.ingest import ingest_stream, windowed_counts

TINY = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("d", "r", "d"), ("e", "r", "f"), ("a", "q", "b")]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(*f, "s1", str(i), i) for i, f in enumerate(TINY)], "subject string, relation string, object string, sample_id string, source_text_id string, seq long")


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from graphloom import session

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        session.shared_dir(unset)
    assert session.stored(spark.range(3), "some").count() == 3


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, name string")
    ids = lambda q: sorted(r.id for r in filters.match_documents(df, q).collect())
    assert ids({}) == [1, 2, 3] and ids(None) == [1, 2, 3]
    assert ids({"name": None}) == [2] and ids({"name": {"$in": []}}) == []
    assert ids({"name": {"$in": ["x", None]}}) == [1, 2]
    assert ids({"$or": [{"id": 1}, {"name": "y"}]}) == [1, 3]
    assert ids({"$and": [{"id": {"$in": [1, 3]}}, {"name": "y"}]}) == [3]
    for bad in ({"id": {"$gt": 1}}, {"$not": []}, {"$or": {}}):
        with pytest.raises(ValueError):
            filters.compile_filter(bad)
    mixed = spark.createDataFrame([("10",), ("9",), ("b",), (None,), ("b",)], "v string")
    assert [r.v for r in filters.distinct_values(mixed, "v").collect()] == ["9", "10", "b"]


def test_upsert(spark):
    old = spark.createDataFrame([("a", None, 1, 0)], "k string, j string, v int, seq int")
    new = spark.createDataFrame([("a", None, 2, 1), ("b", "x", 3, 2), ("b", "x", 4, 3)], old.schema)
    first = {(r.k, r.j): r.v for r in tables.upsert(old, new, ["k", "j"], "seq").collect()}
    last = {(r.k, r.j): r.v for r in tables.upsert(old, new, ["k", "j"], "seq", "last").collect()}
    assert first == {("a", None): 1, ("b", "x"): 3} and last == {("a", None): 2, ("b", "x"): 4}


def test_catalog_and_stream(spark, tmp_path):
    catalog = tables.Catalog(spark, str(tmp_path / "db"))
    assert catalog.missing(("triplets",)) == ["triplets"]
    catalog.provision()
    assert set(catalog.names()) == set(schemas.MODE_TABLES["structured"])
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"sample_id": "s", "source_text_id": "0", "text": "Paris is located in France."}) + "\n")
    passages = spark.readStream.schema("sample_id string, source_text_id string, text string").json(str(source))

    def extract(batch):
        raw = refine.extract(batch, models.PatternExtractor()).drop("exception_text")
        return {"initial_triplets": raw, "triplets": raw}

    for _ in range(2):
        ingest_stream(passages, catalog, extract, str(tmp_path / "check")).awaitTermination()
        assert [(r.subject, r.object) for r in catalog.read("triplets").collect()] == [("Paris", "France")]
        (source / "b.json").write_text(json.dumps({"sample_id": "s", "source_text_id": "0", "text": "Paris is located in France."}) + "\n")
    assert catalog.read("initial_triplets").count() == 1
    catalog.drop("triplets")
    assert not catalog.exists("triplets")


def test_catalog_rewrites_only_what_a_batch_touches(spark, tmp_path):
    catalog = tables.Catalog(spark, str(tmp_path / "db"), buckets=8)
    rows = lambda *names, v=0: spark.createDataFrame([(n, f"k{n}", v) for n in names], "sample_id string, k string, v int")
    catalog.write("t", rows(*"abcdefgh"))
    before = catalog.parts("t")
    catalog.upsert("t", rows("a", "z", v=1), ["sample_id", "k"])
    after = catalog.parts("t")
    assert {p for p in after if after[p] != before.get(p)} <= {f"b{b:04d}" for b in catalog._touched(rows("a", "z"), catalog.bucket(["sample_id"]))}
    held = lambda: {(r.sample_id, r.v) for r in catalog.read("t").collect()}
    assert held() == {*((n, 0) for n in "abcdefgh"), ("z", 1)}
    catalog.upsert("t", rows("b", v=7).withColumn("_order", F.lit(1)), ["sample_id", "k"], "_order", "last")
    assert ("b", 7) in held() and ("b", 0) not in held()
    catalog.delete_sample("t", "b")
    assert "b" not in {n for n, _ in held()} and len(held()) == 8
    catalog.append("t", rows("a", v=9).withColumn("more", F.lit("x")))
    assert {(r.v, r.more) for r in catalog.read("t").where("sample_id = 'a'").collect()} >= {(9, "x")}
    catalog.write("t", rows("q"))
    assert {n for n, _ in held()} == {"q"}
    assert not catalog.ensure_vector_index("t", "v", 3) and catalog.ensure_vector_index("t", "v", 4) and catalog.vector_indexes["t"].dims == 4
    catalog.create_indexes("t", ["k"])
    again = tables.Catalog(spark, str(tmp_path / "db"), buckets=8)
    assert again.indexes == {"t": ["k"]} and again.vector_indexes == catalog.vector_indexes and again.names() == ["t"]
    other = tables.Catalog(spark, str(tmp_path / "other"))
    other.provision()
    other.append("entity_aliases", spark.createDataFrame([("l", "t", "a", "s", [1.0, 2.0])], schemas.SCHEMAS["entity_aliases"]))
    assert other.drop_incompatible(2) == [] and other.drop_incompatible(3) == ["entity_aliases"] and other.read("entity_aliases").count() == 0


def test_windowed_counts(spark, sf):
    events = fixtures.table(spark, sf, "events")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_graph_statistics(tiny):
    size = graph.graph_size(tiny).first()
    assert (size.nodes, size.edges, size.mean_degree) == (6, 6, 2.0)
    found = {r.node: r.clustering for r in graph.local_clustering(tiny).collect()}
    assert found == pytest.approx({"a": 1, "b": 1, "c": 1 / 3, "d": 0, "e": 0, "f": 0})
    assert graph.largest_component(tiny).first()[0] == 4
    assert graph.largest_component(tiny.limit(0)).first()[0] == 0
    assert graph.sample_components(tiny).first().largest_component == 4
    assert {(r.subject, r.object): r.relation for r in graph.last_relation(tiny).collect()}["a", "b"] == "q"


def test_components_of_random_graphs(spark):
    import random

    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_k_hop_is_breadth_first(tiny, spark):
    seeds = spark.createDataFrame([("a",)], "name string")
    one, two = (sorted(r.source_text_id for r in graph.k_hop(tiny, seeds, d).collect()) for d in (1, 2))
    assert one == ["0", "2", "6"] and two == ["0", "1", "2", "3", "6"]
    assert graph.k_hop(tiny, seeds, 2, sample_id="other").count() == 0
    assert graph.one_hop(tiny, spark.createDataFrame([], "name string")).count() == 0


def test_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "y"), (3, [1.0, 1.0], "x"), (4, [], "z"), (5, [1.0, 0.0], "")], "id int, v array<float>, label string")
    best = vector.vector_search(table, vector.VectorQuery([1.0, 0.0], 3, column="v"), "id").collect()
    assert [r.id for r in best] == [1, 5, 3] and best[0].score == 1.0
    assert vector.vector_search(table, vector.VectorQuery([], 3, column="v"), "id").count() == 0
    with pytest.raises(ValueError):
        vector.vector_search(table, vector.VectorQuery([1.0], 3, column="v"), "id", dims=2)
    with pytest.raises(ValueError):
        vector.vector_search(table, vector.VectorQuery([1.0], 3, column="nope"), "id")
    assert [r.label for r in vector.cosine_fallback(table, [1.0, 0.0], "label", "v", 5).collect()] == ["x", "y"]
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "q string, qv array<float>")
    found = vector.batch_top_k(queries, table, 2, "q", "qv", "id", "v").orderBy("rank").collect()
    assert [r.id for r in found] == [1, 5]


def test_distinct_top_k_equals_the_doubling_loop():
    import random

    draw = random.Random(1)
    for _ in range(300):
        ranking, k = [draw.randrange(6) for _ in range(draw.randrange(1, 400))], draw.randrange(1, 5)
        limit, literal = 2 * k, []
        for _ in range(5):
            literal = list(dict.fromkeys(ranking[:limit]))[:k]
            if len(literal) == k:
                break
            limit *= 2
        assert list(dict.fromkeys(ranking[: vector.prefix_length(k, "properties")]))[:k] == literal


def test_ontology_rules(spark):
    types, properties = fixtures.ontology(spark)
    valid = {r.entity_type_id: (r.as_subject, r.as_object) for r in ontology.valid_properties(types).collect()}
    assert valid["E1"] == (["P1", "P5", "P6", "P7"], ["P3", "P7"])
    closure = {(r.child, r.ancestor) for r in ontology.transitive_closure(spark.createDataFrame(fixtures.SUBCLASS_EDGES, "child string, parent string")).collect()}
    assert {("a", "d"), ("m", "m"), ("m", "n"), ("n", "m"), ("x", "x")} <= closure and ("d", "a") not in closure
    rows = spark.createDataFrame([("E5", "E1", "P3", ["E5"], ["E1"], ["E5"], ["E1", "E7"]), (None, "E1", None, None, None, None, ["E1"]), ("E1", "E3", "P8", [], ["E3"], ["E1"], ["E3"]), ("E1", "E2", "P7", ["ANY"], ["ANY"], ["E1"], ["E2"])], "subject_type_id string, object_type_id string, property_id string, valid_subject_type_ids array<string>, valid_object_type_ids array<string>, subject_ancestors array<string>, object_ancestors array<string>")
    assert [r.exception_text.split("\n") for r in ontology.validate_backbone(rows).collect()] == [[""], ["subject type is not in the ontology", "relation is not in the ontology"], ["subject type violates the constraint"], [""]]
    ids = spark.createDataFrame([("P10",), ("P9",)], "id string")
    assert [r.id for r in ids.orderBy(*ontology.numeric_id_order("id")).collect()] == ["P9", "P10"]
    kept = ontology.labelled_only(spark.createDataFrame([(1, ["E1", "gone", "ANY"]), (2, ["gone"])], "_row int, t array<string>"), types, "t", "entity_type_id")
    assert {r._row: r.t for r in kept.collect()} == {1: ["E1", "ANY"], 2: []}


def test_text_functions(spark):
    cases = ["7,531", "7.531", "1,2,3", "3.14 a.b", "He-llo,  W_orld!", "Čapek", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    assert [r.n for r in df.orderBy("i").select(text.normalize(F.col("t")).alias("n")).collect()] == ["7531", "7531", "123", "314 a b", "he llo w orld", "capek", ""]
    payloads = ['{"triplets": []}', '```json\n{"triplets": [{"subject": "a"}]}\n```', 'So: {"triplets": [{"subject": "a", "qualifiers": [{"relation": "r", "object": "o"}]}]} ok', "[1]", '{"triplets": null}', "{}", "", '{"triplets": [{"su', None]
    parsed = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, t string").select("i", text.parse_triplets(F.col("t")).alias("p")).orderBy("i").collect()
    assert [None if r.p is None else len(r.p.triplets) for r in parsed] == [0, 1, 1, None, None, None, None, None, None]
    none = spark.createDataFrame([("None.",), ("none",), ("'None'",)], "t string").select(text.is_none_answer(F.col("t")).alias("n"))
    assert [r.n for r in none.collect()] == [True, False, True]
    chunks = text.chunk_random(spark.createDataFrame([("d", " ".join(f"S{i}." for i in range(23)))], "d string, t string"), "d", "t").collect()
    sizes = [len(r.chunk.split()) for r in chunks]
    assert sum(sizes) == 23 and all(3 <= s <= 8 for s in sizes)


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"s1": ["x", "y"], "s2": ["z"]}))
    assert readers.json_dataset(spark, str(tmp_path / "a.json")).count() == 3
    (tmp_path / "b.jsonl").write_text('{"s1": ["x", "y"]}\n{"s2": ["z"]}\n')
    assert {r.sample_id: r.text for r in readers.jsonl_dataset(spark, str(tmp_path / "b.jsonl")).collect()} == {"s1": "x\ny", "s2": "z"}
    (tmp_path / "c.jsonl").write_text('{"a":\n 1}\n{"a": 2} {"a": ')
    assert [(json.loads(r.json)["a"] if not r.corrupt else None) for r in readers.tolerant_jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("pos").collect()] == [1, 2, None]
    (tmp_path / "d.txt").write_text("12:see Q42 here\nx:none\n")
    assert [(r.line_no, r.entity_id) for r in readers.dump_lines(spark, str(tmp_path / "d.txt")).collect()] == [(12, "Q42"), (None, None)]
    page = spark.createDataFrame([(1, '<p>One <a href="#" title="T1">x</a></p><p> </p><h2>Later</h2><p>Two</p>')], "page_id long, html string")
    assert [(r.paragraph, r.links) for r in readers.page_paragraphs(page).collect()] == [("One x", ["T1"])]
    essays = spark.createDataFrame([(7, "title\n\np1\n\np2")], "id int, content string")
    assert [r.text for r in readers.convert_essays(essays, "id", "content").collect()] == ["p1", "p2"]
    musique = spark.createDataFrame([("q", [("p0",), ("p1",)])], "id string, paragraphs array<struct<paragraph_text:string>>")
    assert readers.convert_musique(musique).count() == 2
    hotpot = spark.createDataFrame([("q", [("t", ["a.", "b."])])], "_id string, context array<struct<title:string,sentences:array<string>>>")
    assert readers.convert_hotpot(hotpot).first().text == "a. b."
    assert readers.RunConfig.of({"samples": None, "odd": 1, "hop_depth": 2}) == readers.RunConfig(hop_depth=2)


def test_names_are_refined_in_order(spark):
    facts = spark.createDataFrame([("s", "0", 0, "Marie Curie", "city", "Paris", "city"), ("s", "1", 0, "Marie Curies", "city", "Pariss", "city"), ("t", "0", 0, "Pariss", "city", "x", "city")], "sample_id string, source_text_id string, seq long, subject string, subject_type string, object string, object_type string")
    aliases = spark.createDataFrame([], schemas.SCHEMAS["entity_aliases"])
    out = {(r.sample_id, r.source_text_id): (r.subject, r.object) for r in refine.refine_names(facts, aliases, models.HashEmbedder(), models.SimilarityChooser()).collect()}
    assert out == {("s", "0"): ("Marie Curie", "Paris"), ("s", "1"): ("Marie Curie", "Paris"), ("t", "0"): ("Pariss", "x")}


def plain_fold(facts, aliases, embedder, chooser, typed, k=10):
    """refine_names one fact at a time."""
    known = {}
    for sample, kind, label, alias in aliases:
        known.setdefault((sample, kind if typed else ""), {})[alias] = label
    out = []
    for sample, source, seq, *ends in sorted(facts):
        said = []
        for name, kind in (ends[:2], ends[2:]):
            own = known.setdefault((sample, kind if typed else ""), {})
            if name not in own:
                me = embedder.one(name)
                near = sorted((-round(float(np.dot(me, embedder.one(a))), 9), a) for a in own)[: k if typed else 150]
                labels = list(dict.fromkeys(own[a] for _, a in near))[:k]
                own[name] = (chooser(name, labels) if labels else None) or name
            said.append(own[name])
        out.append((sample, source, *said))
    return sorted(out)


@pytest.mark.parametrize("typed", [False, True])
def test_names_equal_a_plain_fold(spark, typed, monkeypatch):
    import random

    monkeypatch.setattr(refine.AliasFold, "SCORES", 64)
    draw = random.Random(3)
    names = [f"{a}{b} {c}" for a in ("Mar", "Per", "Tol") for b in ("ie", "in", "on", "ies") for c in ("Curie", "Curi", "Smith", "Smiths")]
    facts = [(f"s{draw.randrange(3)}", f"{i:04d}", 0, draw.choice(names), draw.choice("xy"), draw.choice(names), draw.choice("xy")) for i in range(400)]
    stored = [(f"s{i % 2}", "xy"[i % 2], f"L{i}", f"Marie Curi{i}") for i in range(6)]
    df = spark.createDataFrame(facts, "sample_id string, source_text_id string, seq long, subject string, subject_type string, object string, object_type string")
    aliases = spark.createDataFrame(stored, "sample_id string, entity_type string, label string, alias string")
    embedder, chooser = models.HashEmbedder(), models.SimilarityChooser(least=0.7)
    found = refine.refine_names(df.repartition(5), aliases, embedder, chooser, typed=typed)
    wanted = plain_fold(facts, stored, embedder, chooser, typed)
    assert sorted((r.sample_id, r.source_text_id, r.subject, r.object) for r in found.collect()) == wanted
    assert len({w[2] for w in wanted}) < len({f[3] for f in facts})


def test_relations_are_ranked_among_allowed_properties(spark):
    from graphloom.plans.queries import _ontology_with_aliases

    onto = _ontology_with_aliases(spark)
    onto.chooser = models.SimilarityChooser(least=-1.0)
    # Nearer than any alias of a property that orders and customers allow, but of one that they do not.
    near = refine.embedded(spark.createDataFrame([(f"put in by {i}",) for i in range(400)], "alias_label string"), "alias_label", onto.embedder, "alias_text_embedding")
    onto.property_aliases = onto.property_aliases.unionByName(near.withColumn("relation_id", F.lit("P4")))
    facts = spark.createDataFrame([("Order#1", "put in by", "Ann", "E5", "E1"), ("Order#1", "put in by", "Part#1", "E5", "E6"), ("Order#1", None, "Ann", "E5", "E1"), ("Order#1", "put in by", "Ann", None, "E1")], "subject string, relation string, object string, subject_type_id string, object_type_id string")
    facts = facts.withColumns({"subject_type": F.lit("order"), "object_type": F.lit("x")})
    out = {(r.relation, r.property_id) for r in refine.refine_relations(facts, onto).collect()}
    assert out == {("placed by", "P3"), ("contains", "P4"), (None, None), ("put in by", None)}


@pytest.mark.parametrize("typed", [False, True])
def test_untyped_names_see_k_distinct_labels(spark, typed):
    class Last:
        def __call__(self, name, candidates, context=""):
            return "|".join(candidates)

    stored = [("s", "", "near", f"Paris {i}") for i in range(14)] + [("s", "", "far", "Lyon on the Rhone")]
    aliases = spark.createDataFrame(stored, "sample_id string, entity_type string, label string, alias string")
    facts = spark.createDataFrame([("s", "0", 0, "Paris", "")], "sample_id string, source_text_id string, seq long, subject string, subject_type string")
    out = refine.refine_names(facts, aliases, models.HashEmbedder(), Last(), typed=typed, columns=("subject",)).first()
    assert out.subject == ("near" if typed else "near|far")


def test_failures_are_rows(spark):
    class Broken:
        def __call__(self, text):
            raise ValueError(text)

    out = refine.extract(spark.createDataFrame([("s", "0", "boom")], "sample_id string, source_text_id string, text string"), Broken()).collect()
    assert [r.exception_text for r in out] == ["ValueError: boom"]


def test_dynamic_ingestion(spark):
    passages = spark.createDataFrame([("s", "0", "Paris is located in France."), ("s", "1", "Lyon is located in France.")], "sample_id string, source_text_id string, text string")
    empty, none = spark.createDataFrame([], schemas.SCHEMAS["entity_aliases"]), spark.createDataFrame([], schemas.SCHEMAS["dynamic_property_aliases"])
    out = refine.ingest_dynamic(passages, models.PatternExtractor(), empty, none)
    assert sorted((r.subject, r.relation, r.object) for r in out["triplets"].collect()) == [("Lyon", "is located in", "France"), ("Paris", "is located in", "France")]


def test_collapsing_questions(spark):
    edges = spark.createDataFrame([("Paris", "capital of", "France", "0"), ("France", "part of", "Europe", "1")], "subject string, relation string, object string, source_text_id string")
    names = refine.embedded(spark.createDataFrame([("Paris",), ("France",), ("Europe",)], "name string"), "name", models.HashEmbedder())
    asked = spark.createDataFrame([(1, "Paris capital of"), (2, None)], "question_id int, question string")
    out = {r.question_id: r.answer for r in qa.answer_by_collapsing(asked, edges, names, models.OverlapAnswerer(), lambda q: [q, "#1 part of"] if q else []).collect()}
    assert out == {1: "Europe", 2: None}
    scored = qa.score_answers(spark.createDataFrame([(1, "the Europe")], "question_id int, answer string"), spark.createDataFrame([(1, "Europe")], "question_id int, truth string")).first()
    assert scored.exact == 0 and scored.f1 == pytest.approx(2 / 3)


def test_models():
    assert models.HashEmbedder()(["", None]) == [None, None]
    calls = []

    def flaky(feedback):
        calls.append(feedback)
        if len(calls) < 3:
            raise ValueError("no")
        return "ok"

    assert models.RetryPolicy(5).run(flaky, sleep=lambda s: None) == "ok" and calls == [None, "no", "no"]
    assert re.fullmatch(r"kg_m_1_onto", models.database_name("kg", "m/1", True))

    class Small:
        dims = 1

        def __call__(self, texts):
            if len(texts) > 2:
                raise MemoryError
            return [[1.0]] * len(texts)

    assert len(models.embed_in_chunks(Small(), ["x"] * 7)) == 7
