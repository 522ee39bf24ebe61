"""The corpus operators against brute-force versions, round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, common, exact_dedup, language_id, near_dedup, ngram_lm, packing, pii, quality, tagger, token_counts, topk_search, unit_encoder
from graphloom.llm.common import strings, text_chunks, word_hashes

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
#: Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, and columns whose names the operators use.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en", "s"), (2, "the  QUICK brown fox jumps over the lazy dog again", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \n\t ", "fr", "s"),
    (6, LONG, "en", "s"), (6, LONG, "en", "s"), (None, "The quick brown fox jumps over the lazy dog again", "en", "s"), (None, None, None, None), (7, "two words", "de", "s"), (8, "Two words", "de", "s"),
    (9, "Mail joe.x@mail.example.com or +1 (386) 555-3733, card 4047054433953522, ip 10.0.0.255!", "en", "s"), (10, "日本語 テキスト 🙂 naïve café", "ja", "s"), (11, LONG + " tail", "en", "s"), (12, "1234 5678 ### ---", "en", "s"),
]
CLASH = ["kept", "key", "n", "bands", "text_sha256", "_text", "score", "comp", "stage", "ids", "n_tokens", "doc_tokens", "spans"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]


def words(text):
    return (text or "").encode().lower().split()


# 1 near-duplicates


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, (b, y) in enumerate(sets):
        for a, x in sets[:j]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i, _ in rows}


def test_near_dedup_equals_brute_force(docs, plain):
    found = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    expected = brute_components([(i, t) for i, t, _ in plain])
    assert {i: r.component_id for i, r in found.items()} == expected
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(shingles(t)) for i, t, _ in plain}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_near_dedup_of_a_chain_in_one_bucket(spark):
    """Neighbours of a chain are alike, its ends are not: links between members other than a bucket's least one must not be lost."""
    rng, base = np.random.default_rng(4), [f"w{i}" for i in range(400)]
    rows, text = [], list(base)
    for i in range(40):
        for at in rng.integers(0, 400, 3):
            text[at] = f"n{i}_{at}"
        rows.append((int(i), " ".join(text)))
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("known", [0, 9])
def test_block_comparison(spark, monkeypatch, known):
    """Many members in few blocks: links across blocks join what they should, and none join what is apart. ``known`` members of the
    first group are one component beforehand; they are not compared with each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = [" ".join(f"g{g}w{i}" for i in range(200)).replace(f"g{g}w{k} ", "z ") for g in range(2) for k in range(5, 18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = F.when(F.col("doc_id") < known, 0).otherwise(F.col("doc_id")).cast("long")
    key = F.lit(0).cast("long")
    sketched = near_dedup.sketch(docs).select(F.col("doc_id").alias("class_id"), "n", F.transform("bands", lambda b: key).alias("bands"), "filled")
    rows = docs.select(key.alias("key"), F.col("doc_id").alias("class_id"), comp.alias("comp"))
    monkeypatch.setattr(near_dedup, "passes_estimate", lambda a, b, *rest: np.ones(len(a), bool))
    sizes = spark.createDataFrame([(0, 0, max(1, known), len(texts))], "key long, most long, many long, size long")
    sets = near_dedup._sets(docs, docs.select("doc_id")).withColumnRenamed("doc_id", "class_id")
    links = near_dedup._within_blocks(rows, sizes, sketched.join(sets, "class_id")).collect()
    assert all((r.a < 13) == (r.b < 13) for r in links) and len(links) < 13 * 13
    joined = near_dedup.connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "u long, v long"))
    assert {r.node: r.component for r in joined.collect()} == {i: 13 * (i // 13) for i in range(26) if not 0 < i < known}


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    sets = []
    for shared, own in ((600, 100), (120, 20), (20, 3), (300, 300)):
        x = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
        sets += [np.unique(x[: shared + own]), np.unique(x[own:])]
    values, filled = near_dedup.registers(sets)
    keys, bits = (values.view(np.uint64) ^ near_dedup._SALTS).view(np.int64), np.packbits(filled, axis=1, bitorder="little").view(np.int64)
    n = np.array([len(s) for s in sets])
    assert near_dedup.passes_estimate(keys[::2], keys[1::2], bits[::2], bits[1::2], n[::2], n[1::2]).tolist() == [True, True, True, False]


# 2 language-model scores


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (1000, 1200), (5000, 10**12), (300, 100)):
        values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        coded = ngram_lm.EliasFano.build(values)
        assert (coded[np.arange(n)] == values).all()
        distinct = np.unique(values)
        coded = ngram_lm.EliasFano.build(distinct)
        asked = np.concatenate([distinct, rng.integers(0, top + 9, 500).astype(np.uint64)])
        begin = rng.integers(0, len(distinct) + 1, len(asked))
        end = np.minimum(len(distinct), begin + rng.integers(0, 90, len(asked)))
        at = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
        hit = (distinct[at] == asked) & (at >= begin) & (at < end)
        assert (coded.find(asked, begin, end) == np.where(hit, at, -1)).all()


def plain_scores(rows, train, order, borders=()):
    """Scores by dictionaries; discounts are those of the shard that an n-gram's first two words belong to."""
    tokens = {i: [*words(t), None] for i, t in rows}
    grams = [Counter() for _ in range(order + 1)]
    for i in train:
        for k in range(1, order + 1):
            grams[k].update(tuple(tokens[i][a : a + k]) for a in range(len(tokens[i]) - k + 1))
    total, size = sum(grams[1].values()), len(grams[1])
    hashed = {w: int(ngram_lm.END) if w is None else int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for (w,) in grams[1]}
    number = {w: n for n, w in enumerate(sorted(hashed, key=hashed.get))}
    bits = max(1, (size + 1).bit_length())
    shard = lambda g: int(np.searchsorted(borders, (number[g[0]] << bits) | number[g[1]], "right"))
    taken, after = {}, [defaultdict(list) for _ in range(order + 1)]
    for k in range(2, order + 1):
        by = defaultdict(list)
        for g, c in grams[k].items():
            by[shard(g)].append(c)
        taken |= {(k, s): ngram_lm.discounts(np.array(c)) for s, c in by.items()}
        for g, c in grams[k].items():
            after[k][g[:-1]].append(taken[k, shard(g)][min(c, 3) - 1])
    out = {}
    for i, t in tokens.items():
        score = base = 0.0
        for a in range(len(t)):
            p = (grams[1][t[a],] + 0.5) / (total + 0.5 * (size + 1))
            base += math.log10(p)
            for k in range(2, min(order, a + 1) + 1):
                g = tuple(t[a - k + 1 : a + 1])
                c = grams[k][g]
                if g[:-1] in after[k]:
                    n = grams[k - 1][g[:-1]]
                    p = ((c - taken[k, shard(g)][min(c, 3) - 1]) / n if c else 0.0) + sum(after[k][g[:-1]]) / n * p
            score += math.log10(p)
        out[i] = base, score, len(t), sum(grams[1][w,] > 0 for w in t), total
    return out


@pytest.mark.parametrize("order,parts", [(2, 1), (3, 1), (4, 1), (2, 7), (3, 7), (4, 7)])
def test_ngram_scores_equal_plain_ones(spark, monkeypatch, order, parts):
    """One shard and several (a frequent first word is cut between them), several blocks, words seen and unseen."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{min(40, int(x))}" for x in rng.exponential(6, int(rng.integers(0, 60))))) for i in range(80)] + [(80, None), (81, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = df.where("doc_id % 3 <> 1 AND doc_id < 81")
    used, plainly = [], ngram_lm.Vocabulary.borders
    monkeypatch.setattr(ngram_lm.Vocabulary, "borders", lambda self, _: used.append(plainly(self, parts)) or used[-1])
    found = {r.doc_id: r for r in ngram_lm.score_documents(df, train, order=order).collect()}
    assert len(used[0]) == parts - 1
    expected = plain_scores(rows, [i for i, _ in rows if i % 3 != 1 and i < 81], order, used[0])
    for i, (base, score, n, known, total) in expected.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-7)
        assert r.score == pytest.approx(score, abs=0.03 * n)  # 8-bit steps


def test_borders_cut_the_text_evenly(tmp_path):
    """From one number for each file of the vocabulary they are what the counts of all words give."""
    rng = np.random.default_rng(4)
    store, shards, counts = ngram_lm.Store(str(tmp_path)), [], []
    for i, n in enumerate((1, 50, 7, 300)):
        own = np.maximum(1, rng.pareto(0.8, n) * 5).astype(np.int64)
        hashes = np.sort(rng.integers(i << 60, (i + 1) << 60, n).astype(np.uint64))
        store.write(f"vocab-{i:06d}", {"hash": hashes, "count": own})
        shards.append((f"vocab-{i:06d}", int(hashes[0]), n, int(own.sum())))
        counts += own.tolist()
    vocabulary = ngram_lm.Vocabulary(store, shards)
    running, total = np.concatenate([[0], np.cumsum(counts)]), sum(counts)
    place = lambda tokens: next(i for i in range(len(counts) - 1, -1, -1) if running[i] <= tokens)
    wanted = set()
    for share in (total * np.arange(1, 40) // 40).tolist():
        first = place(share)
        wanted.add((first << vocabulary.bits) | place(int((share - running[first]) / counts[first] * total)))
    assert vocabulary.borders(40).tolist() == sorted(wanted)
    assert vocabulary.counts(1, 60).tolist() == counts[1:61] and vocabulary.counts(0, 0).tolist() == counts[:1]


def test_a_store_that_is_not_mounted_is_fetched(tmp_path, monkeypatch):
    store = ngram_lm.Store(f"file://{tmp_path}/there")
    store.make()
    store.write("trie-000001", {"a": np.arange(5), "b": np.zeros(0, np.uint8), "c": np.arange(3, dtype=np.uint32)})
    here = pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem())  # not taken for a mounted one
    monkeypatch.setattr(ngram_lm.Store, "_there", lambda self: (here, "there"))
    monkeypatch.setattr(ngram_lm.tempfile, "gettempdir", lambda: str(tmp_path / "cache"))
    for _ in range(2):
        found = store.open("trie-000001")
        assert found["a"].tolist() == [0, 1, 2, 3, 4] and not len(found["b"]) and found["c"].tolist() == [0, 1, 2]
    assert len(list((tmp_path / "cache").rglob("trie-*"))) == 1


def test_ngram_scores_over_shards(docs):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = ngram_lm.score_documents(docs, docs.where(~held_out), shard_words=5_000).withColumn("held", held_out).collect()
    for held in (True, False):
        mine = [r for r in rows if r.held == held]
        assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(r.score < 0 for r in rows)


# 3 packing


def check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return len(by_sequence)


def test_packing(docs, plain):
    rows = packing.pack_documents(docs, "byte_bpe_50k.tiktoken", P.PATTERN, shard_bytes=200_000).collect()
    sequences = check_pieces(rows, {i: t for i, t, _ in plain})
    assert sum(r.length for r in rows) / (sequences * packing.WINDOW) > 0.95


def test_bm25_index():
    texts = ["a b c", "a b d", "e f g", "a b c d", "h i j", "k l m", "n o p"]
    hashes, rows = map(np.concatenate, zip(*[(h, r + lo) for lo, hi, data, offsets in text_chunks(strings(pa.array(texts))) for h, r in [word_hashes(data, offsets)]]))
    scores = packing.Index(hashes, rows, len(texts)).scores(0)
    n, avg = len(texts), np.mean([len(t.split()) for t in texts])
    for d, text in enumerate(texts):
        own = 0.0
        for term in set(texts[0].split()):
            df, tf = sum(term in t.split() for t in texts), text.split().count(term)
            if df > 1 and tf:
                own += max(0.0, math.log((n - df + 0.5) / (df + 0.5))) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(text.split()) / avg))
        assert scores[d] == pytest.approx(own)


# 4 exact duplicates


def test_exact_dedup_edge_cases(odd):
    rows = exact_dedup.exact_dedup(odd, digest=True).collect()
    assert len(rows) == len(ROWS)
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[re.sub(r"[ \t-\r]+", " ", text or "")].append(i)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in rows if r.text_sha256 == digest]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and all(r.group_size == len(ids) and r.keep_id == keep for r in mine)
        assert sum(r.kept for r in mine) == 1


def test_joins_without_broadcast_give_the_same(docs, odd, monkeypatch):
    for df in (docs, odd):
        results = []
        for most in (common.BROADCAST_ROWS, -1):
            monkeypatch.setattr(common, "BROADCAST_ROWS", most)
            results.append((sorted(map(str, exact_dedup.exact_dedup(df).collect())), sorted(map(str, exact_dedup.keep_first(df).collect()))))
        assert results[0] == results[1]


def test_kept_rows_keep_all_columns(odd):
    df = odd.withColumnsRenamed({"source": "_digest", "lang": "_0"})
    assert exact_dedup.keep_first(df).columns == df.columns
    kept = exact_dedup.keep_first(df).collect()
    texts = Counter(re.sub(r"[ \t-\r]+", " ", r.text or "") for r in kept)
    assert set(texts.values()) == {1} and len(texts) == len({re.sub(r"[ \t-\r]+", " ", t or "") for _, t, *_ in ROWS})


# 5 byte-level BPE


ODD_TEXTS = ["", "  a  b\n\n c", " \t x  ", "a" * 3000 + "  zz", "don't x\u0085 y  z", "日本語 テキスト🙂🙂  ok", " ", "\n \n", "a \n b \r\n  c", "x\x1c y \x1f", LONG]


def test_byte_bpe_equals_the_library(docs, plain):
    bpe = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [t for _, t, _ in plain] + ODD_TEXTS
    ids = bpe.encode(texts)
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert [bpe.decode(i) for i in ids] == [t.encode() for t in texts]
    found = {r.doc_id: r for r in byte_bpe.encode_digests(docs, "byte_bpe_multi_50k.tiktoken", P.PATTERN).collect()}
    for (i, t, _), own in zip(plain, ids):
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(own) // 4, hashlib.sha256(own).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def unit_ids(coder, texts):
    """The ids of each text, by chunks as the packing makes them."""
    out = []
    for _, _, data, offsets in text_chunks(strings(pa.array(texts, pa.string())), 50_000):
        ids, ends = coder.encode(data, offsets)
        out += [i.astype("<u4").tobytes() for i in np.split(ids, ends[:-1])]
    return out


def test_unit_encoder_equals_tokenizers(plain):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t for _, t, _ in plain] + ODD_TEXTS
    coder = unit_encoder.UnitEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert unit_ids(coder, texts) == wanted
    assert unit_ids(coder, texts[::-1]) == wanted[::-1]


def test_unit_encoder_starts_afresh_and_survives_collisions(plain, monkeypatch):
    texts = [t for _, t, _ in plain][:40] + ODD_TEXTS
    wanted = unit_ids(unit_encoder.UnitEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), texts)
    monkeypatch.setattr(unit_encoder, "CACHE_BYTES", 100)
    assert unit_ids(unit_encoder.UnitEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), texts) == wanted
    monkeypatch.setattr(unit_encoder, "span_hashes", lambda data, a, b, lower: np.asarray(b - a, np.uint64) << np.uint64(40))
    assert unit_ids(unit_encoder.UnitEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), texts) == wanted


def test_unit_encoder_knows_added_tokens():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"foo{mark}bar", f"a {mark} b", f"a  {mark}\n\n b", mark, mark * 3, f"{mark} x", f"x \t{mark}", f"{mark[:-1]} > {mark[1:]}", f"one two{mark}three  four {mark}", "none", "", mark[:6], mark[6:]]
    coder = unit_encoder.UnitEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert unit_ids(coder, texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert unit_ids(coder, texts[:1]) == [np.array([21943, 50256, 5657], "<u4").tobytes()]


# 6 language identification


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language_id.identify(docs, language_id.learn_profiles(docs.where(~held))).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98 and all(0 <= r.score <= 1 for r in found)


def plain_grams(text):
    """Codes of one to three letters of each word, with a border on either side of it."""
    code = lambda gram: sum((1 if c == " " else ord(c) + 2) << 21 * (2 - i) for i, c in enumerate(gram))
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            edged = f" {word} "
            out += [code(g) for g in word] + [code(edged[i : i + 2]) for i in range(len(edged) - 1)] + [code(edged[i : i + 3]) for i in range(len(edged) - 2)]
            word = ""
    return out


def test_language_query_equals_brute_force(spark, docs, plain):
    import __spark_entry__ as entry

    ranked = lambda counts: [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language_id.PROFILE]]
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in plain}
    grams = {i: Counter(plain_grams(t)) for i, t, _ in plain}
    totals = defaultdict(Counter)
    for i, _, lang in plain:
        if not held[i] and lang is not None:
            totals[lang] += grams[i]
    profiles = {lang: {c: r for r, c in enumerate(ranked(n))} for lang, n in totals.items()}
    found = {r.doc_id: r for r in entry.queries()["op6_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(plain)
    for i, _, _ in plain:
        own = ranked(grams[i])
        away = {lang: sum(abs(r - p[c]) if c in p else language_id.PROFILE for r, c in enumerate(own)) for lang, p in profiles.items()}
        lang = min(away, key=lambda k: (away[k], k)) if own else "und"
        assert (found[i].held_out, found[i].lang_pred) == (held[i], lang)
        assert found[i].score == pytest.approx(1 - away[lang] / (language_id.PROFILE * len(own)) if own else 0.0)


def test_ngrams_of_words():
    codes, rows = language_id.ngram_codes(["Ab!", "1", "b"])
    assert Counter(rows.tolist()) == {0: 2 + 3 + 2, 2: 1 + 2 + 1}


# 7 quality


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.resample(docs, labels).join(labels, "doc_id").collect()
    kept = {g: np.mean([r.kept for r in rows if r.quality == g]) for g in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.1


def plain_features(text):
    """Words and pairs of words, one at a time: runs of letters, of digits or of marks, lower-cased."""
    raw = (text or "").encode()
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isascii() and chr(b).isalpha() or b > 127 else 2 if 48 <= b <= 57 else 3
    tokens, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and kind(raw[end]) == kind(raw[at]):
            end += 1
        if kind(raw[at]):
            tokens.append(raw[at:end].lower())
        at = end
    own = [int(common.span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    pairs = [int(common.mix(np.array([(3 * a + b) % 2**64], np.uint64))[0]) for a, b in zip(own, own[1:])]
    return [h % quality.BUCKETS for h in own + pairs]


def test_quality_query_equals_brute_force(spark, docs, plain):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    side = {r.doc_id: r.half for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("half")).collect()}
    good = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    features = {i: Counter(plain_features(t)) for i, t, _ in plain}
    raw, target = Counter(), Counter()
    for i, f in features.items():
        raw += f
        if side[i] and good.get(i) == 1:
            target += f
    rate = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log(target[b] + quality.SMOOTHING) - math.log(raw[b] * rate + quality.SMOOTHING)
    mean = {i: sum(n * ratio(b) for b, n in f.items()) / max(1, sum(f.values())) for i, f in features.items()}
    judged = {g: np.array([mean[i] for i in mean if not side[i] and good.get(i) == g]) for g in (0, 1)}
    border = quality.border_between(judged[1], judged[0])
    weight = {i: quality.LEAD * (m - border) / (float(np.median(judged[1])) - border) for i, m in mean.items()}
    key = {i: w - math.log(-math.log(float(common.uniform(np.array([i]), quality.SEED)[0]))) for i, w in weight.items()}
    k = round(sum(1 / (1 + math.exp(-w)) for w in weight.values()))
    least = sorted(key.values(), reverse=True)[k - 1]
    assert 0 < k < len(key)
    for i, r in found.items():
        assert r.log_weight == pytest.approx(weight[i], abs=1e-6) and r.key == pytest.approx(key[i], abs=1e-6) and r.kept == (key[i] >= least)


def test_inclusion_follows_the_weights():
    """Gumbel top-k draws without replacement in proportion to the weights: a level's share kept is 1 - exp(-exp(weight - t)) for one t."""
    model, levels, each = quality.Ratio(np.zeros(1)), np.array([-3.0, -1.0, 0.0, 1.0, 3.0]), 4000
    weights = np.repeat(levels, each)
    keys = model.keys(weights, np.arange(len(weights)), 7)
    k = len(weights) // 2
    kept = (keys >= np.sort(keys)[-k]).reshape(len(levels), each).mean(1)
    t = min(np.linspace(-5, 5, 2001), key=lambda t: abs((1 - np.exp(-np.exp(levels - t))).mean() - 0.5))
    assert kept == pytest.approx(1 - np.exp(-np.exp(levels - t)), abs=0.03) and (np.diff(kept) > 0.05).all()


def test_the_draw_matters_near_the_border(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    k = sum(r.kept for r in rows)
    plainly = sorted(rows, key=lambda r: -r.log_weight)[:k]
    assert k - sum(r.kept for r in plainly) >= 5


def test_quality_without_labels_keeps_everything(odd):
    labels = odd.select("doc_id", F.lit(1).alias("quality"))
    assert quality.keep(odd, labels).count() == quality.keep(odd, labels.limit(0)).count() == len(ROWS)
    assert all(r.kept for r in quality.resample(odd, labels).collect())


def test_kth_greatest(spark):
    values = [float(v) for v in np.random.default_rng(0).normal(0, 100, 3000)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 777, 2999):
        assert quality.kth_greatest(df, "v", k, parts=16) == ordered[k - 1]
    assert quality.kth_greatest(df, "v", 0) == math.inf and quality.kth_greatest(df, "v", 9999) == -math.inf


# 8 personal data


def plain_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return pii.in_order(out)


def test_base_spans_equal_plain_patterns(plain):
    import random

    draw = random.Random(3)
    texts = [t for _, t, _ in plain] + ["".join(draw.choice("a@.1234+- ()b%") for _ in range(draw.randint(0, 60))) for _ in range(4000)] + ["".join(draw.choice("12.") for _ in range(40)) for _ in range(500)]
    assert [pii.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]


@pytest.fixture(scope="module")
def learned(spark):
    """A tagger that has seen the documents of sf0.1 whose remainder is not 1."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def test_gradients():
    net = tagger.Tagger(pii.KINDS, hidden=3)
    ids, tags = np.array([[97, 49, 64]]), np.array([[0, 1, 2]])
    loss, grads = net._gradients(ids, tags)
    for name, at in (("hf", (0, 1)), ("o", (1, 2)), ("t", (1, 2)), ("xb", (49, 3)), ("cf", (2,))):
        net.p[name][at] += 1e-5
        assert (net._gradients(ids, tags)[0] - loss) / 1e-5 == pytest.approx(grads[name][at], abs=1e-3)
        net.p[name][at] -= 1e-5


def test_tagger_on_held_out_documents_and_pieces(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r.text for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()]
    for texts, wanted, least in ((held, [pii.label_spans(t) for t in held], 0.95), (*zip(*pii.drawn_pieces(600, [], seed=99)), 0.85)):
        base = [pii.base_spans(t) for t in texts]
        said = [set(pii.all_spans(b, f, t)) for b, f, t in zip(base, learned.spans(list(texts)), texts, strict=True)]
        hits = sum(len(f & set(w)) for f, w in zip(said, wanted, strict=True))
        assert hits >= least * sum(map(len, wanted)) and hits >= least * sum(map(len, said))
        # Of what the patterns cannot find, most is found, and little else is said.
        beyond = [set(w) - set(b) for w, b in zip(wanted, base, strict=True)]
        added = [f - set(b) for f, b in zip(said, base, strict=True)]
        hits = sum(len(f & w) for f, w in zip(added, beyond, strict=True))
        assert hits >= 0.8 * sum(map(len, beyond)) > 0 and hits >= 0.85 * sum(map(len, added))


def plain_reading(net, text):
    """Every window by the training code, averages in a loop, and the best path through the whole text."""
    ids = tagger.char_ids(text)
    sums, weights = np.zeros((len(ids), net.tags)), np.zeros(len(ids))
    start = 0
    while len(ids):
        row = np.full((1, tagger.WINDOW), tagger.PAD)
        own = ids[start : start + tagger.WINDOW]
        row[0, : len(own)] = own
        e = np.concatenate([net._one_way(row, s)[0] for s in "fb"], 2)[0] @ net.p["o"] + net.p["ob"]
        for i in range(len(own)):
            weight = min(i + 1, tagger.WINDOW - i)
            sums[start + i] += weight * e[i]
            weights[start + i] += weight
        if start + tagger.WINDOW >= len(ids):
            break
        start += tagger.STRIDE
    return tagger.spans_of(net.decode(sums / weights[:, None]), net.kinds) if len(ids) else []


def test_reading_between_frozen_positions_equals_the_whole_path(plain, learned, monkeypatch):
    texts = [t for _, t, _ in plain][:60] + [" ".join(t for t, _ in pii.drawn_pieces(40, [], seed=5)), "x" * 23, "x" * 24, "x" * 25, "+1 (386) 555-3733", ""]
    wanted = [plain_reading(learned, t) for t in texts]
    assert learned.spans(texts) == wanted and sum(map(len, wanted)) > 20
    monkeypatch.setattr(tagger, "SLAB", 400)  # long texts are read slab by slab
    assert learned.spans(texts) == wanted
    draw = np.random.default_rng(1)  # networks that know nothing have few frozen positions and many spans
    for seed in range(3):
        net = tagger.Tagger(pii.KINDS, seed=seed)
        net.p["o"] *= 30
        net.p["t"] = draw.uniform(-tagger.MOST_TRANSITION, tagger.MOST_TRANSITION, net.p["t"].shape)
        assert net.spans(texts[:12]) == [plain_reading(net, t) for t in texts[:12]]


def test_pii_query_equals_brute_force(docs, plain, learned):
    found = {r.doc_id: r for r in pii.find_spans(docs, learned).collect()}
    assert len(found) == len(plain)
    for i, text, _ in plain:
        base = plain_spans(text)
        every = pii.all_spans(base, plain_reading(learned, text), text)
        assert found[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and found[i].spans == pii.joined(every)
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS] and found[i].n_added == len(every) - len(base)


def test_sampled_pieces_come_from_whole_texts(spark):
    texts = ["".join(chr(97 + (7 * i + j) % 26) if j % 50 else "é7" for j in range(1500)) for i in range(20)] + ["same text 1 " * 9] * 500 + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    pieces = pii.sample_pieces(df, marked=10_000, plain=10_000)
    assert len(set(pieces)) == len(pieces) and all(any(p in (t or "") for t in texts) for p in pieces)
    assert all("".join(t[a : a + 20]) in "\n".join(pieces) for t in texts[:20] for a in (0, 1470))
    few = pii.sample_pieces(df, marked=8, plain=0)
    assert 0 < len(few) <= 8 and set(few) <= set(pieces)
    assert len(pii.sample_pieces(df.limit(0))) == 0


def test_redaction_keeps_other_columns(odd):
    out = {r.doc_id: r for r in pii.redact(odd, tagger.Tagger(pii.LEARNED)).collect()}
    assert out[9].text == "Mail <email> or <phone>, card <card>, ip <ip>!" and out[9].kept == "x" and out[3].text is None


# 9 token counts


def test_token_counts_equal_plain_search(docs, plain):
    pieces = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    trie = token_counts.PieceTrie(pieces)

    def count(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * trie.byte_score, best[end - 1][1] + n)]
            options += [(best[a][0] + pieces[word[a:end]], best[a][1] + 1) for a in range(max(0, end - trie.longest), end) if word[a:end] in pieces]
            best.append(min(options, key=lambda o: (-o[0], o[1])))
        return best[-1][1]

    found = {r.doc_id: r for r in token_counts.token_counts(docs, "piece_bpe_32k.model").collect()}
    counts = {}
    for i, text, _ in plain:
        split = text.encode().split()
        for w in set(split) - counts.keys():
            counts[w] = count(token_counts.MARK + w.decode())
        assert (found[i].n_pretokens, found[i].n_tokens) == (len(split), sum(counts[w] for w in split))


def test_token_counts_of_odd_rows(odd, monkeypatch):
    found = defaultdict(list)
    for r in token_counts.token_counts(odd, "piece_bpe_32k.model").collect():
        found[r.doc_id].append((r.n_pretokens, r.n_tokens))
    assert found[3] == found[4] == found[5] == [(0, 0)] and found[6][0] == found[6][1] and found[6][0][0] == 20_000 and (0, 0) in found[None] and found[7][0][0] == 2
    trie = token_counts.PieceTrie(token_counts.read_pieces(P.path("piece_bpe_32k.model")))
    words = [token_counts.MARK + w for w in ("quick", "quicker", "quick", "naïve", "🙂", "")]
    once = [trie.insert(w) for w in words]
    trie.clear()
    assert [trie.insert(w) for w in words[::-1]][::-1] == once and once[0] == once[2]


# 10 top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.integers(-20, 20, 8 if i % 7 else 5).tolist()) for i in range(300)] + [(300 + i, [1, 2, 3]) for i in range(30)] + [(999, None)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    found = defaultdict(list)
    for r in topk_search.top_k(df.where("vec_id % 20 = 0"), df, 7, shard_rows=40, query_rows=5).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for q, v in vectors:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if w is not None and i != q]
            assert found[q] == [(i, -s) for s, i in sorted(scores)[:7]]


@pytest.mark.parametrize("filled", [0.05, 0.6, 1.0])
def test_maxscore_of_a_shard(filled):
    draw = np.random.default_rng(int(100 * filled))
    vectors = draw.integers(-40 if filled > 0.5 else 0, 40, (700, 24)) * (draw.random((700, 24)) < filled)
    vectors[300:330] = vectors[5]  # ties
    ids = draw.permutation(700)
    shard = topk_search.Shard(ids, vectors)
    assert bool(shard.short) == (filled < 0.5)
    for q in [*range(0, 700, 23), 5, 310]:
        scores = vectors @ vectors[q]
        wanted = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q])[:20]
        found = shard.top(int(ids[q]), vectors[q], 20)
        assert [(-int(s), int(i)) for i, s in zip(*found)] == wanted


def test_vectors_outside_essential_lists_are_never_scored():
    vectors = np.zeros((1000, 12), np.int64)
    vectors[:30, 0] = 50
    vectors[:, 1:] = np.random.default_rng(0).integers(0, 2, (1000, 11))
    shard, seen = topk_search.Shard(np.arange(1000), vectors), []
    traverse = shard.traverse
    shard.traverse = lambda sums, terms, weights: (seen.append(terms.tolist()), traverse(sums, terms, weights))
    query = np.array([50, *[1] * 11])
    assert shard.top(-1, query, 20)[1].min() > 2500 and sum(map(len, seen)) == topk_search._FIRST


def test_topk_ignores_other_columns_and_finds_repeated_rows(spark):
    rows = [(i % 40, [(7 * (i % 40)) % 11 - 5, i % 40 % 3]) for i in range(50)] + [(None, [1, 1]), (90, None), (91, [3])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<bigint>").withColumns({c: F.lit("x") for c in ("v", "shard", "block", "score", "rank", "query_id")})
    found = topk_search.top_k(df.where("vec_id % 20 = 0"), df, k=8).collect()
    plain = {}
    for q, v in {(i, tuple(v)) for i, v in rows if i is not None and i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows if i is not None and c is not None and i != q)
        plain.setdefault(q, []).append([(i, -s) for s, i in scored[:8]])
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert all(len(v) == 1 for v in plain.values()) and {q: v[0] for q, v in plain.items()} == dict(by)


def test_topk_without_rows(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (20, [float("nan")]), (40, None), (60, [2.0])], "vec_id long, e array<float>")
    good = df.where(topk_search.usable(F.col("e"))).select("vec_id", F.transform("e", lambda x: F.floor(x)).alias("vector"))
    assert [r.vec_id for r in good.collect()] == [60] and topk_search.top_k(good, good).count() == 0
    assert topk_search.top_k(good.limit(0), good.limit(0)).count() == 0


# Edge cases of all


def run_all(docs):
    profiles = language_id.learn_profiles(docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return {
        "near": near_dedup.near_dedup(docs),
        "scores": ngram_lm.score_documents(docs, docs),
        "exact": exact_dedup.exact_dedup(docs),
        "bpe": byte_bpe.encode_documents(docs, "byte_bpe_multi_50k.tiktoken", P.PATTERN),
        "language": language_id.identify(docs, profiles),
        "quality": quality.resample(docs, labels),
        "pii": pii.find_spans(docs, tagger.Tagger(pii.LEARNED)),
        "tokens": token_counts.token_counts(docs, "piece_bpe_32k.model"),
    }


def test_empty_tables(none):
    assert {k: df.count() for k, df in run_all(none).items()} == dict.fromkeys(run_all(none), 0)
    assert packing.pack_documents(none, "byte_bpe_50k.tiktoken", P.PATTERN).count() == 0
    assert exact_dedup.keep_first(none).count() == 0 and quality.keep(none, none.select("doc_id", F.lit(1).alias("quality"))).count() == 0


def test_odd_rows(odd):
    out = {k: df.collect() for k, df in run_all(odd).items()}
    assert all(len(rows) == len(ROWS) for rows in out.values()), {k: len(v) for k, v in out.items()}
    near = {r.doc_id: r.component_id for r in out["near"]}
    assert near[1] == near[2] == 1 and near[7] == near[8] == 7 and near[6] == near[11] == 6 and near[3] == 3 and near[4] == 4 and near[None] is None
    scores = {r.doc_id: r for r in out["scores"]}
    assert scores[3].n_tokens == scores[4].n_tokens == scores[5].n_tokens == 1 and scores[6].n_tokens == 20_001
    langs = {r.doc_id: (r.lang_pred, r.score) for r in out["language"]}
    assert langs[3] == langs[4] == langs[12] == ("und", 0.0)
    bpe = {r.doc_id: r for r in out["bpe"]}
    assert bpe[3].ids == b"" and bpe[10].decoded.decode() == ROWS[12][1]
    pieces = packing.pack_documents(odd, "byte_bpe_50k.tiktoken", P.PATTERN, with_ids=True).collect()
    assert sum(r.length for r in pieces if r.doc_id == 6) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 6)
    assert exact_dedup.keep_first(odd).count() == len({re.sub(r"[ \t-\r]+", " ", t or "") for _, t, *_ in ROWS})


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns and 0 < rows.count() <= before.count()
        texts = [(r.doc_id, r.text) for r in rows.collect()]
        if name == "exact_dedup":
            assert len({re.sub(r"[ \t-\r]+", " ", t) for _, t in texts}) == len(texts)
            assert {i for i, _ in texts} == {min(ids) for ids in _groups(before).values()}
        if name == "near_dedup":
            assert {i for i, _ in texts} == set(brute_components([(r.doc_id, r.text) for r in before.collect()]).values())
        if name == "pii":
            assert not any(plain_spans(t) for _, t in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
    check_pieces(pieces, dict(texts))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert tokenizer.decode(np.frombuffer(pieces[0].ids, "<u4").tolist()[:-1])


def test_pipeline_of_odd_rows_and_of_none(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns with names that operators use."""
    import corpus_pipeline

    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, rows = rows.count(), stage(spark, rows, str(tmp_path)).cache()
            assert rows.columns == odd.columns and rows.count() <= before
        texts = [r.text for r in rows.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
        assert sum(r.start == 0 for r in pieces) == len(texts)
    start = odd.where("doc_id IS NULL OR doc_id <> 12")
    kept = corpus_pipeline.drop_exact_copies(spark, start, "")
    assert Counter(re.sub(r"[ \t-\r]+", " ", r.text or "") for r in kept.collect()).most_common(1)[0][1] == 1
    near = corpus_pipeline.drop_near_copies(spark, kept, "")
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in near.collect()} == {2, 8, 11}


def _groups(df):
    out = defaultdict(list)
    for r in df.collect():
        out[re.sub(r"[ \t-\r]+", " ", r.text)].append(r.doc_id)
    return out


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11))
