"""Every query with SQL is run beside it on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.functions import models
from graphloom.plans import registry
from graphloom.sources import fixtures

QUERIES, ORACLES = registry()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(shown(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    mine = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, mine.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_questions_are_asked_of_all_facts(spark, sf):
    from graphloom.functions.models import OverlapAnswerer
    from graphloom.sources import fixtures

    facts = fixtures.initial_triplets(spark, sf).select("source_text_id", "subject", "relation", "object").collect()
    near = {}
    for _, s, r, o in facts:
        near.setdefault(s, set()).add((s, r, o))
        near.setdefault(o, set()).add((s, r, o))
    found = {r.question_id: r for r in QUERIES["qa_end_to_end"](spark, sf).collect()}
    assert found.keys() == {f.source_text_id for f in facts}
    for i, s, _, _ in facts:
        assert found[i].answer == OverlapAnswerer()(found[i].question, sorted(near[s]))


def test_ingestion_that_merges_names(spark, sf):
    from test_operators import plain_fold

    facts = [(r.sample_id, r.source_text_id, 0, r.subject, r.subject_type, r.object, r.object_type) for r in fixtures.initial_triplets(spark, sf).collect()]
    wanted = sorted(w[1:] for w in plain_fold(facts, [], models.HashEmbedder(), models.SimilarityChooser(least=0.9), True))
    found = sorted((r.source_text_id, r.subject, r.object) for r in QUERIES["ingest_structured_merging"](spark, sf).collect())
    assert found == wanted and {f[1] for f in found} < {f[3] for f in facts}


def test_random_chunks_equal_a_plain_draw(spark, sf):
    import random
    import re

    found = {}
    for r in QUERIES["chunk_random"](spark, sf).collect():
        found.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk))
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        marked = re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", doc.text or "")
        sentences = [t for t in (s.strip(" ") for s in marked.split("\x01")) if t]
        draw, at, wanted = random.Random(f"0:{doc.doc_id}"), 0, []
        while at < len(sentences):
            left = len(sentences) - at
            take = left if left <= 5 else draw.randint(3, 5)
            take = left if left - take < 4 else take
            wanted.append((len(wanted) + 1, " ".join(sentences[at : at + take])))
            at += take
        assert sorted(found.get(doc.doc_id, [])) == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 37
    assert set(entry.oracle_sql()) <= set(entry.queries())
