"""Sinks, the ontology build, look-ups of names, multi-step answers and the engine's tools."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.engine import Engine
from graphloom.functions import language_model, models, text
from graphloom.operators import aligner, build, graph, qa, refine, tables
from graphloom.plans import registry
from graphloom.sources import ontology_source, readers, sinks

MAPS = {
    "subj_constraint2prop": {"E1": ["P2", "P1"], "E3": ["P9"]},
    "obj_constraint2prop": {"E2": ["P1"]},
    "entity_type2label": {"E1": "city", "E2": "country", "E3": "nowhere"},
    "entity_type2hierarchy": {"E1": ["E1", "E2"], "E2": ["E2"]},
    "entity_type2aliases": {"E1": ["town", "big place"], "E9": ["unknown"]},
    "prop2constraints": {"P1": {"Subject type constraint": ["E1"], "Value-type constraint": ["E2"]}, "P2": {"Subject type constraint": ["E1"], "Value-type constraint": ["ANY"]}},
    "prop2label": {"P1": "capital of", "P2": "population", "P3": "without constraints"},
    "prop2aliases": {"P1": ["seat of"], "P2": []},
}


@pytest.fixture(scope="module")
def maps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("maps")
    for name, value in MAPS.items():
        (folder / f"{name}.json").write_text(json.dumps(value))
    return readers.mappings(spark, str(folder))


def test_ontology_build(spark, maps, tmp_path):
    catalog = tables.Catalog(spark, str(tmp_path / "onto"), buckets=4)
    for _ in range(2):
        assert build.build_ontology(catalog, maps) == {"entity_types": 2, "entity_type_aliases": 3, "properties": 2, "property_aliases": 3}
    types = {r.entity_type_id: r for r in catalog.read("entity_types").collect()}
    assert types["E1"].valid_subject_property_ids == ["P2", "P1"] and types["E1"].parent_type_ids == ["E1", "E2"] and types["E2"].valid_object_property_ids == ["P1"] and types["E2"].valid_subject_property_ids == []
    assert {(r.relation_id, r.alias_label) for r in catalog.read("property_aliases").collect()} == {("P1", "capital of"), ("P1", "seat of"), ("P2", "population")}
    assert all(np.allclose(r.alias_text_embedding, models.HashEmbedder().one(r.alias_label)) for r in catalog.read("entity_type_aliases").collect())
    assert catalog.vector_indexes["property_aliases"].dims == 64 and catalog.indexes["properties"] == ["property_id"]


def test_files(spark, maps, tmp_path):
    whole = lambda folder: "".join(p.read_text() for p in sorted(tmp_path.joinpath(folder).glob("part-*")))
    sinks.write_mapping(maps["prop2aliases"], str(tmp_path / "aliases"))
    sinks.write_mapping(maps["prop2constraints"], str(tmp_path / "constraints"))
    sinks.write_mapping(maps["prop2label"].limit(0), str(tmp_path / "none"))
    assert json.loads(whole("aliases")) == MAPS["prop2aliases"] and json.loads(whole("constraints")) == MAPS["prop2constraints"] and json.loads(whole("none")) == {}
    rows = [("b", "10", "later"), ("b", "9", 'with "quotes"\nand lines'), ("a", "0", "one")]
    sinks.write_dataset(spark.createDataFrame(rows, "sample_id string, source_text_id string, text string").repartition(3), str(tmp_path / "data"))
    (tmp_path / "data.json").write_text(whole("data"))
    assert json.loads(whole("data")) == {"a": ["one"], "b": ['with "quotes"\nand lines', "later"]}
    assert {(r.sample_id, r.source_text_id, r.text) for r in readers.json_dataset(spark, str(tmp_path / "data.json")).collect()} == {("a", "0", "one"), ("b", "0", rows[1][2]), ("b", "1", "later")}
    name = sinks.answers_name("store", "m/1", multi_step=True, run=2)
    for i in range(2):
        sinks.append_answers(spark.createDataFrame([(f"s{i}", None if i else "x")], "sample_id string, answer string"), str(tmp_path / name))
    assert name == "store_m_1_multi_step_True_run_2"
    assert sorted(map(json.loads, whole(name).splitlines()), key=str) == [{"sample_id": "s0", "answer": "x"}, {"sample_id": "s1", "answer": None}]
    lost = maps["prop2constraints"].select(F.col("id").alias("property_id")).limit(1)
    report = [r.value for r in sinks.write_summary({"prop2label": maps["prop2label"]}, {"properties": lost}, str(tmp_path / "report")).collect()]
    assert report == ["prop2label: 3", "", "Items excluded due to missing labels", "properties without label: 1"]


def test_input_that_does_not_parse_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "bad.jsonl").write_text('{"a": ["x"]}\nnonsense\n')
    for read, name in ((readers.json_dataset, "bad.json"), (readers.jsonl_dataset, "bad.jsonl")):
        with pytest.raises(Exception, match="not a JSON object"):
            read(spark, str(tmp_path / name)).collect()
    (tmp_path / "qa.jsonl").write_text('{"_id": 7, "question": "q", "answer": "a"}\n')
    assert readers.keyed_questions(spark, str(tmp_path / "qa.jsonl")).first().asDict() == {"id": "7", "question": "q", "answer": "a"}


@pytest.mark.parametrize("distinct", [False, True])
def test_similar_names_equal_brute_force(spark, distinct):
    rows = [(f"name {i % 5}{i}", f"L{i % 7}", f"s{i % 2}") for i in range(60)]
    embedder = models.HashEmbedder()
    aliases = aligner.with_embeddings(spark.createDataFrame(rows, "alias string, label string, sample_id string"), embedder)
    asked = [(0, "name 11", "s1"), (1, "name 42", None), (2, "name 3", "s9")]
    found = aligner.similar_entity_names(spark.createDataFrame(asked, "query_id int, name string, sample_id string"), aliases, embedder, 4, distinct)
    got = {q: [r.label for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r.place)] for q, _, _ in asked}
    for q, name, sample in asked:
        near = sorted((-round(float(np.dot(np.array(embedder.one(name), np.float32).astype(float), np.array(embedder.one(a), np.float32).astype(float))), 6), f"{a}\x01{label}\x01{s}", label) for a, label, s in rows if sample in (None, s))
        labels = [label for _, _, label in near]
        assert got[q] == (list(dict.fromkeys(labels))[:4] if distinct else labels[:4])


def test_aliases_are_embedded_where_they_have_no_vector(spark, tmp_path):
    for mode, sample in (("structured", "all"), ("dynamic", None)):
        catalog = tables.Catalog(spark, str(tmp_path / mode), mode)
        catalog.provision()
        rows = spark.createDataFrame([("l", "t", "a", "", [1.0, 2.0]), ("l", "t", "b", "s", None), ("l", "t", "b", "s", [3.0])], schemas.SCHEMAS["entity_aliases"])
        aligner.add_entities(catalog, rows)
        held = {(r.alias, r.sample_id): r.alias_text_embedding for r in catalog.read("entity_aliases").collect()}
        assert held["a", sample if sample else ""] == [1.0, 2.0] and len(held["b", "s"]) in (1, 64) and len(held) == 2
    aligner.add_properties(catalog, spark.createDataFrame([("p", "q")], "label string, alias string"))
    assert len(catalog.read("property_aliases").first().alias_text_embedding) == 64


def test_an_answerer_sees_the_nearest_facts(spark):
    asked = spark.createDataFrame([(1, "which part of France"), (2, None)], "question_id int, question string")
    facts = [(1, f"x{i}", "is", "y") for i in range(5)] + [(1, "a", "part of", "France"), (1, "a", "part of", "France"), (1, "b", "part of", "Spain"), (2, "c", "is", "d")]
    found = qa.nearest_facts(asked, spark.createDataFrame(facts, "question_id int, subject string, relation string, object string"), 3)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "part of", "France"), (1, "b", "part of", "Spain"), (1, "x0", "is", "y"), (2, "c", "is", "d")]


def test_answers_in_steps(spark):
    edges = spark.createDataFrame([("Paris", "capital of", "France", "0"), ("France", "part of", "Europe", "1"), ("Rome", "capital of", "Italy", "2")], "subject string, relation string, object string, source_text_id string")
    names = refine.embedded(spark.createDataFrame([(n,) for n in ("Paris", "France", "Europe", "Rome", "Italy")], "name string"), "name", models.HashEmbedder())
    asked = spark.createDataFrame([(1, "Paris capital of, then it part of"), (2, "Rome capital of"), (3, None), (4, "Paris capital of, then it part of, then it part of")], "question_id int, question string")
    out = {r.question_id: r for r in qa.answer_by_steps(asked, edges, names, models.OverlapAnswerer(), models.ThenStepper()).collect()}
    assert (out[1].answer, out[1].answers, out[1].asked) == ("Europe", ["France", "Europe"], ["Paris capital of", "France part of"])
    assert out[2].answer == "Italy" and len(out[2].asked) == 1 and out[3].answer is None and len(out[4].asked) == 3
    short = {r.question_id: r.answer for r in qa.answer_by_steps(asked, edges, names, models.OverlapAnswerer(), models.ThenStepper(), rounds=1).collect()}
    assert short[1] == "France"  # the answer of the last round


@pytest.mark.parametrize("structured", [True, False])
def test_engine_and_its_tools(spark, tmp_path, structured):
    from graphloom.plans.queries import _ontology_with_aliases

    onto = _ontology_with_aliases(spark) if structured else None
    catalog = tables.Catalog(spark, str(tmp_path / "db"), "structured" if structured else "dynamic", buckets=4)
    catalog.provision()
    engine = Engine(catalog, models.LineExtractor(), models.OverlapAnswerer(), onto)
    tools = engine.tools()
    assert len(tools) == 6
    extract = "extract_triplets_with_ontology_filtering" if structured else "extract_triplets"
    passage = "Order#1; placed by; Ann Smith; order; customer\nAnn Smith; located in country; Peru; customer; country"
    assert tools[extract](passage, "s", "p1")["triplets"].count() == 2 and catalog.read("triplets").count() == 0
    for _ in range(2):
        tools[f"{extract}_and_add_to_db"](passage, "s", "p1")
    facts = catalog.read("triplets").collect()
    assert {(f.subject, f.relation, f.object) for f in facts} == {("Order#1", "placed by", "Ann Smith"), ("Ann Smith", "located in country", "Peru")} and len(facts) == 2
    assert all(f.prompt_token_num == refine.count_words(passage) and f.completion_token_num > 0 for f in facts)
    assert tools["retrieve_similar_entity_names"]("Ann Smit", 1, "s") == ["Ann Smith"]
    assert tools["identify_relevant_entities_from_question"]("what is Ann Smith known for") == ["Ann Smith"]
    assert tools["get_1_hop_supporting_triplets"](["Peru"]).count() == 1
    assert tools["answer_question"]("in which country is Ann Smith located", "s") == "Peru"


def test_json_amid_prose(spark):
    cases = {'{"a":1}': '{"a":1}', 'use {x} then {"a":{"b":2}} ok {': '{"a":{"b":2}}', "x [1,2] y": "[1,2]", '```json\n{"q":1}\n```': '{"q":1}', "none": "none", 'a {"k":"}"} b {"m":2}': '{"k":"}"}'}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r.t: r.j for r in df.select("t", text.extract_json(F.col("t")).alias("j")).collect()} == cases | {None: None}
    said = spark.createDataFrame([(' "caf\\u00e9" ',), ("\\u0041bc \\u00e9",), ('a \\"b\\"',), (None,)], "t string").select(text.sanitize(F.col("t")).alias("s")).collect()
    assert [r.s for r in said] == ['"caf\\u00e9"', "Abc é", "a b", None]


def test_plain_letters_and_maps(spark):
    cases = {"Žižek Ñandú façade": "Zizek Nandu facade", "Straße Łódź": "Strasse Lodz", "Щука жук": "Shchuka zhuk", "Ｆｕｌｌ": "Full", "e\u0301": "e", "ệ ǭ": "e o", "日本": "日本"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", text.ascii_letters(F.col("t")).alias("p")).collect()} == cases
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"c": "4"}), ({"d": "5"}, None)], "l map<string,string>, r map<string,string>")
    assert [r.m for r in maps.select(text.merge_maps(F.col("l"), F.col("r")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"c": "4"}, {"d": "5"}]


def test_choosers_of_their_own(spark):
    from graphloom.plans.queries import _ontology_with_aliases

    onto = _ontology_with_aliases(spark)
    onto.type_chooser, onto.relation_chooser = lambda name, candidates, context="": "order", lambda name, candidates, context="": "contains"
    facts = spark.createDataFrame([("Order#1", "holds", "Part#1", "purchase", "part")], "subject string, relation string, object string, subject_type string, object_type string")
    row = refine.refine_relations(refine.refine_types(facts, onto), onto).first()
    assert (row.subject_type, row.relation, row.property_id) == ("order", "contains", "P4")


def test_section_chunks(spark):
    df = spark.createDataFrame([("f", "section_1", " ".join(f"S{i}." for i in range(9))), ("f", "section_2", "")], "filename string, section string, text string")
    assert [(r.section, r.chunks) for r in text.chunk_sections(df).collect()] == [("section_1", {1: "S0. S1. S2. S3.", 2: "S4. S5. S6. S7. S8."})]


def test_typed_paths(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "q", "c"), ("b", "q", "d"), ("a", "r", "b")], "subject string, relation string, object string")
    assert sorted(r.path for r in graph.typed_paths(edges, ["r", "q"]).collect()) == ["a -> r -> b -> q -> c", "a -> r -> b -> q -> d"]


def test_similar_names_query(spark, sf):
    rows = registry()[0]["similar_names"](spark, sf).collect()
    asked = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 100 = 0").count()
    assert len({r.query_id for r in rows}) == asked > 0 and all(r.score == 1.0 for r in rows if r.place == 1)


class Script:
    """A client that answers from a list and remembers what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, system, user):
        self.asked.append((system, user))
        return language_model.Completion(self.answers.pop(0), 10, 2)


def model(*answers):
    client = Script(*answers)
    return language_model.LanguageModel(client, retry=models.RetryPolicy(3, base_s=0)), client


def test_language_model_calls():
    m, client = model("sorry", '{"triplets": 3}', 'Here: ```json\n{"triplets": [{"subject": "a"}]}\n```')
    assert language_model.ModelExtractor(m)("some text") == [{"subject": "a"}] and (m.prompt_tokens, m.completion_tokens) == (30, 6)
    assert "rejected: no JSON" in client.asked[1][0] and "rejected: triplets is not a list" in client.asked[2][0] and "some text" in client.asked[0][1]
    m, _ = model("x", "x", "x")
    with pytest.raises(RuntimeError):
        language_model.ModelExtractor(m)("t")
    chosen = lambda kind, answer: language_model.ModelChooser(model(answer)[0], kind)("n", ["b", "c"])
    assert chosen("subject_ranker", " b ") == "b" and chosen("object_ranker", "None.") is None and chosen("object_ranker", "elsewhere") is None
    assert chosen("relation_ranker", '{"relation": "c"}') == "c" and chosen("relation_ranker_wo_entity_types", "c") == "c" and chosen("entity_types_ranker", '{"subject_type": "b", "object_type": "x"}') == "b"
    assert language_model.ModelChooser(model()[0])("n", []) is None
    linker = language_model.ModelLinker(model('["Paris", "Rome"]', '[{"entity": "Rome"}]')[0])
    assert linker("q") == ["Paris", "Rome"] and linker.relevant("q", ["Paris", "Rome"]) == ["Rome"]
    assert language_model.ModelAnswerer(model("None")[0])("q", [("a", "b", "c")]) is None
    stepper = language_model.ModelStepper(model("first?", "NOT FINAL", "second?", "done")[0])
    assert (stepper.decompose("q"), stepper.settled("q", ["first?"], ["a"]), stepper.collapse("q", "first?", "a"), stepper.settled("q", ["x"], [None])) == ("first?", None, "second?", "done")


def test_prompt_files(tmp_path):
    (tmp_path / "qa.txt").write_text("Be brief.")
    with pytest.warns(UserWarning):
        prompts = language_model.read_prompts(str(tmp_path))
    assert prompts["qa"] == "Be brief." and prompts.keys() == language_model.USER_PROMPTS.keys() and len(prompts) == 13


def test_language_model_in_executors(spark):
    def client(system, user):
        return language_model.Completion('{"triplets": [{"subject": "' + user.split()[-1] + '", "relation": "r", "object": "o"}]}')

    passages = spark.createDataFrame([("s", "0", "about x"), ("s", "1", "about y")], "sample_id string, source_text_id string, text string")
    facts = refine.extract(passages, language_model.ModelExtractor(language_model.LanguageModel(client))).collect()
    assert {(f.subject, f.prompt_token_num) for f in facts} == {("x", 2), ("y", 2)}


def test_embedders(tmp_path, monkeypatch):
    hidden, mask = np.arange(12.0).reshape(2, 3, 2), np.array([[1, 1, 0], [1, 0, 0]])
    assert models.pool(hidden, mask).tolist() == [[1, 2], [6, 7]] and models.pool(hidden, mask, "cls").tolist() == [[0, 1], [6, 7]]
    assert np.allclose(np.linalg.norm(models.pool(hidden, mask, "cls", True), axis=1), 1)
    with pytest.raises(ValueError):
        models.pool(hidden, mask, "max")
    own = models.EncoderEmbedder(lambda texts: (np.array([[[len(t), 0.0]] for t in texts]), np.ones((len(texts), 1))), 2, normed=True, prefix="p: ")
    assert own(["ab", None, " "]) == [[1.0, 0.0], None, None]
    models.register_embedder("own", lambda: own)
    assert models.load_embedder("own") is own and models.load_embedder("hash").dims == 64
    with pytest.raises(ValueError):
        models.load_embedder("none")
    assert models.model_path("m", "NO_SUCH_VARIABLE", str(tmp_path), "org/m") == "org/m"
    (tmp_path / "m").mkdir()
    assert models.model_path("m", "NO_SUCH_VARIABLE", str(tmp_path), "org/m") == str(tmp_path / "m")
    monkeypatch.setenv("MODEL_FOLDER", str(tmp_path))
    assert models.model_path("m", "MODEL_FOLDER", "/nowhere", "org/m") == str(tmp_path)
    assert [models.truthy(v) for v in ("Yes", "0", None, "")] == [True, False, False, False] and models.truthy(None, True)
    assert models.language_setting("Russian", "prompts") == "prompts_ru"


def test_caches_descriptions_and_settings(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    cache = spark.createDataFrame([("a", [9.0])], "text string, embedding array<float>")
    found, grown = aligner.cached_embeddings(texts, "t", cache, models.HashEmbedder())
    assert {r.text: len(r.embedding) for r in found.collect()} == {"a": 1, "b": 64} and grown.count() == 2
    catalog = tables.Catalog(spark, str(tmp_path / "db"))
    catalog.provision()
    catalog.append("entity_aliases", spark.createDataFrame([("l", "t", "a", "s", [1.0])], schemas.SCHEMAS["entity_aliases"]))
    aligner.resize_vectors(catalog, "entity_aliases", models.HashEmbedder(dims=8))
    assert catalog.check_dimensions("entity_aliases", 8) and catalog.vector_indexes["entity_aliases"].dims == 8
    labels = spark.createDataFrame([("Q2", "two", "d2"), ("Q3", "three", None)], "id string, label string, description string")
    moved = spark.createDataFrame([("Q1", "Q2")], "id string, successor string")
    rows = ontology_source.describe(spark.createDataFrame([("Q1",), ("Q3",), ("Q9",)], "id string"), labels, moved, "id").collect()
    assert {r.id: (r.label, r.description) for r in rows} == {"Q1": ("two", "d2"), "Q3": ("three", None), "Q9": (None, None)}
    old, new = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, description string"), spark.createDataFrame([("a", "z"), ("b", None)], "id string, description string")
    assert {tuple(r) for r in ontology_source.merge_descriptions(old, new, "id").collect()} == {("a", "z"), ("b", "y")}
    config = readers.QuestionConfig.of({"multi_step": True, "samples": None, "odd": 1})
    assert (config.use_qualifiers, config.use_filtered, config.multi_step, config.samples) == (True, False, True, 50) and config.should_dump(True) and not config.should_dump(False)
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a")], "subject string, relation string, object string")
    assert graph.printed_statistics(edges) == "nodes: 3\nedges: 3\nmean degree: 2.0000\nlargest component: 3\nclustering: 1.0000"
    timed = spark.createDataFrame([("q", 1.0), ("q", 3.0)], "label string, ms double")
    assert tuple(graph.timing_means(timed).first()) == ("q", 2.0, 2)
