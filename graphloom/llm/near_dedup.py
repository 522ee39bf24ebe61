"""Near-duplicate detection with HyperMinHash.

A document's set of word shingles is hashed into registers, one a bucket: the number of leading zeros of the bucket's least hash and
the mantissa bits that follow. Empty registers borrow from filled ones by fixed random probing. Bands of compressed registers (four of
16 bits make one 64-bit key) propose pairs; a Jaccard estimate from the filled registers, less the matches expected by chance, drops
pairs far below the threshold; the rest are confirmed on the full sets.

Documents of equal sets are one class from the start, and only classes are compared. In a bucket of the band index every member is
first paired with the least one, which leaves most buckets with one component and nothing to learn. In buckets that still hold several
components only the members outside the most frequent one are compared, with each other and with the rest, in blocks of bounded size;
what passes the estimate is confirmed on the full sets there and then, and only links that join two components of the block are
reported. A member of the most frequent component is copied once for each block of the others, so a bucket of one large group and a few
strangers costs little more than its size. No bucket is capped, sampled or listed pair by pair.

Defined results: texts without words have no shingles and link to nothing; null texts count as empty; texts with fewer words than a
shingle are one shingle; rows with null ids keep a null component and are kept; rows that share an id and differ in text are told apart
by text, unless both lead a class, when they count as one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import mix, text_chunks, word_hashes
from graphloom.operators.components import connected_components
from graphloom.session import cut, stored

WORDS, PERCENT = 5, 75
#: Registers (buckets of the hash), rows of a band, mantissa bits of a register (six more hold the zeros), and members of a block.
REGISTERS, ROWS, MANTISSA, BLOCK = 128, 4, 10, 512
BANDS = REGISTERS // ROWS
#: Standard deviations below the threshold at which the estimate still lets a pair through to the full sets.
SLACK = 5.0

_U = np.uint64
_PROBES = np.random.default_rng(97).integers(0, REGISTERS, (4096, REGISTERS)).astype(np.int64)
#: Each band's keys are told apart by a constant of its own, so that a key alone names band and registers.
_SALTS = np.random.default_rng(96).integers(0, 2**63, BANDS, dtype=_U)
#: Logarithm of the number of buckets in which ids of documents to confirm are broadcast.
ID_BITS = 19
_FACTORS = np.random.default_rng(98).integers(1, 2**63, WORDS, dtype=_U) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    begin = np.searchsorted(rows, np.arange(n + 1))
    out = []
    if len(hashes) >= WORDS:
        rolled = np.zeros(len(hashes) - WORDS + 1, _U)
        for k in range(WORDS):
            rolled += hashes[k : len(hashes) - WORDS + 1 + k] * _FACTORS[k]
        rolled = mix(rolled)
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _FACTORS[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(registers as uint16, whether each is filled by the document itself) of non-empty sets; the others' rows are 0."""
    shift = _U(64 - REGISTERS.bit_length() + 1)
    edges = np.arange(REGISTERS, dtype=_U) << shift
    least, filled = np.zeros((len(sets), REGISTERS), _U), np.zeros((len(sets), REGISTERS), bool)
    for r, own in enumerate(sets):
        if len(own):
            at = np.minimum(np.searchsorted(own, edges), len(own) - 1)
            least[r] = own[at]
            filled[r] = (own[at] >> shift) == np.arange(REGISTERS, dtype=_U)
    rest = (least & ((_U(1) << shift) - _U(1))) | _U(1)
    parts = rest.astype(np.float64).view(_U)  # exponent and mantissa as the machine keeps them
    zeros = _U(1023 + int(shift)) - (parts >> _U(52))
    values = ((zeros << _U(MANTISSA)) | ((parts >> _U(52 - MANTISSA)) & _U((1 << MANTISSA) - 1))).astype(np.uint16)
    values[~filled] = 0
    rows, places = np.nonzero(~filled & filled.any(1)[:, None])
    for probe in _PROBES:
        if not len(rows):
            break
        source = probe[places]
        hit = filled[rows, source]
        values[rows[hit], places[hit]] = values[rows[hit], source[hit]]
        rows, places = rows[~hit], places[~hit]
    return values, filled


def by_chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The chance that a register of two unrelated sets of these sizes matches: both minima fall in one cell of the code."""
    a, b = na / REGISTERS, nb / REGISTERS
    total, out = a + b, np.zeros(len(na))
    for octave in range(64 - MANTISSA):
        high, low = 2.0**-octave, 2.0 ** -(octave + 1)
        out += a * b / total * (np.exp(-total * low) - np.exp(-total * high)) * low / (1 << MANTISSA)
    return out


def passes_estimate(bands_a: np.ndarray, bands_b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the corrected estimate allows a similarity of the threshold. Bands are rows of 64-bit keys, filled rows of bits."""
    va, vb = ((x.view(_U) ^ _SALTS).view(np.uint16).reshape(len(x), REGISTERS) for x in (bands_a, bands_b))
    fa, fb = (np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").astype(bool) for x in (filled_a, filled_b))
    both, either = fa & fb, (fa | fb).sum(1)
    matches = ((va == vb) & both).sum(1) - by_chance(na.astype(float), nb.astype(float)) * both.sum(1)
    least = PERCENT / 100
    return matches / either >= least - SLACK * np.sqrt(least * (1 - least) / either)


def _longs(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.ascontiguousarray(np.array(column.flatten()).reshape(len(column), -1))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, bands and filled bits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                values, filled = registers(sets)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * width, pa.int32()), pa.array(flat.ravel())) for width, flat in ((BANDS, (values.view(_U) ^ _SALTS).view(np.int64)), (REGISTERS // 64, np.packbits(filled, axis=1, bitorder="little").view(np.int64)))]
                sums = [pa.array(np.array([f(s) for s in sets], _U).view(np.int64)) for f in (lambda s: s.sum(dtype=_U), lambda s: np.bitwise_xor.reduce(mix(s), initial=_U(0)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *sums, *lists], names=["doc_id", "n", "k1", "k2", "bands", "filled"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n long, k1 long, k2 long, bands array<long>, filled array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of comparable size that the estimate lets through."""
    sides = [classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("class_id", "n", "bands", "filled")]) for s in "ab"]
    joined = pairs.join(sides[0], pairs["a"] == F.col("class_id_a")).join(sides[1], pairs["b"] == F.col("class_id_b"))
    joined = joined.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ok = passes_estimate(*(_longs(c[x]) for x in ("bands_a", "bands_b", "filled_a", "filled_b")), np.array(c["n_a"]), np.array(c["n_b"])) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], names=["a", "b"])

    return joined.select("a", "b", *[f"{c}_{s}" for s in "ab" for c in ("n", "bands", "filled")]).mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id shares a bucket with one of ``ids``: all that are wanted and few others.

    The buckets are bounded in number, so they may be broadcast, and only these texts need to be shuffled later.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).cast("int")
    wanted = cut(ids.select(bucket.alias("_bucket")).distinct())
    return docs.withColumn("_bucket", bucket).join(F.broadcast(wanted), "_bucket", "left_semi").select("doc_id", "text")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. ``docs``: doc_id, text."""
    docs = _texts_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    sides = [docs.select(F.col("doc_id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"]
    joined = pairs.join(sides[1], pairs["b"] == F.col("id_b")).select("a", "b", "text_b").join(sides[0], F.col("a") == F.col("id_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, str, np.ndarray] | None = None
        for batch in batches:
            ids_a, ok = batch.column(0).to_pylist(), []
            texts = batch.column(2)
            for lo, hi, data, offsets in text_chunks(batch.column(3)):
                for i, b in enumerate(shingle_sets(data, offsets), lo):
                    text = texts[i].as_py()
                    if kept is None or kept[0] != ids_a[i] or kept[1] != text:
                        raw = np.frombuffer(text.encode(), np.uint8)
                        kept = ids_a[i], text, shingle_sets(raw, np.array([0, len(raw)]))[0]
                    shared = len(np.intersect1d(kept[2], b, assume_unique=True))
                    ok.append(100 * shared >= PERCENT * (len(kept[2]) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                ends = np.cumsum([0, *map(len, sets)])
                column = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, _U), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column.cast(pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return _texts_of(docs, ids).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")


def _within_blocks(rows: DataFrame, sizes: DataFrame, sketched: DataFrame) -> DataFrame:
    """Links (a, b) between different components of one bucket, by component, enough to join all that its members' links join.

    ``rows``: key, class_id, comp; ``sizes``: key, most (its most frequent component), many (that one's members) and size (all);
    ``sketched``: class_id, n, bands, filled, shingles. A bucket that fits a block is one. In others the members outside the most frequent
    component are dealt to the first blocks, the rest to those after; pairs of blocks of which at least one is a first one are a run of
    rows in some partition each. A pair is looked at only in the first band that its members share.
    """
    small, held = F.col("size") <= BLOCK, rows.join(sizes, "key")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    held = held.withColumns({"few": small | (F.col("comp") != F.col("most")), "first": F.when(small, 1).otherwise(blocks(F.col("size") - F.col("many"))), "rest": F.when(small, 0).otherwise(blocks(F.col("many")))})
    place = F.xxhash64("class_id")
    own = F.when(F.col("few"), F.pmod(place, F.col("first"))).otherwise(F.col("first") + F.pmod(place, F.col("rest"))).cast("int")
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("first") - 1 + F.when(F.col("few"), F.col("rest")).otherwise(0))))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "class_id", "comp")
    dealt = dealt.join(sketched, "class_id").select("key", "i", "j", "side", "class_id", "comp", "n", "bands", "filled", "shingles")
    keys = ["key", "i", "j"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def compare(t: dict[str, np.ndarray], across: bool) -> list[tuple[int, int]]:
        if across:
            left, right = np.flatnonzero(~t["side"]), np.flatnonzero(t["side"])
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            x, y = np.triu_indices(len(t["comp"]), 1)
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for at in range(0, len(x), 1 << 15):
            p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
            on = (t["comp"][p] != t["comp"][q]) & (100 * np.minimum(t["n"][p], t["n"][q]) >= PERCENT * np.maximum(t["n"][p], t["n"][q]))
            p, q = p[on], q[on]
            if len(p):
                same = t["bands"][p] == t["bands"][q]
                on = t["bands"][p, same.argmax(1)] == t["key"][0]
                p, q = p[on], q[on]
            if len(p):
                on = passes_estimate(t["bands"][p], t["bands"][q], t["filled"][p], t["filled"][q], t["n"][p], t["n"][q])
                p, q = p[on], q[on]
            for a, b in zip(p.tolist(), q.tolist()):
                ca, cb = root(int(t["comp"][a])), root(int(t["comp"][b]))
                if ca != cb:
                    u, v = t["shingles"][a], t["shingles"][b]
                    shared = int(np.count_nonzero(u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v))
                    if 100 * shared >= PERCENT * (len(u) + len(v) - shared):
                        parent[max(ca, cb)] = min(ca, cb)
                        found.append((int(t["comp"][a]), int(t["comp"][b])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "i", "j", "side", "class_id", "comp", "n")
        left: dict[str, np.ndarray] | None = None

        def emit(t: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
            found = [link for a, b in zip(bounds, bounds[1:]) if b - a > 1 for link in compare({k: v[a:b] for k, v in t.items()}, bool(t["i"][a] != t["j"][a]))]
            return pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {k: np.array(batch.column(i)) for i, k in enumerate(names)} | {k: _longs(batch.column(7 + i)) for i, k in enumerate(("bands", "filled"))}
            ends, flat = np.array(batch.column(9).value_lengths()).cumsum(), np.array(batch.column(9).flatten()).view(_U)
            t["shingles"] = np.empty(batch.num_rows, object)
            t["shingles"][:] = np.split(flat, ends[:-1])
            if left is not None:
                t = {k: np.concatenate([left[k], v]) for k, v in t.items()}
            new = np.zeros(len(t["key"]), bool)
            for k in keys:
                new[1:] |= t[k][1:] != t[k][:-1]
            bounds = np.concatenate([[0], np.flatnonzero(new)])
            yield emit(t, bounds)
            left = {k: v[bounds[-1] :] for k, v in t.items()}  # its run may go on in the next batch
        if left is not None:
            yield emit(left, np.array([0, len(left["key"])]))

    return dealt.mapInArrow(run, "a long, b long")


def sketches_and_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sketches by row, classes as k1, k2, n, component_id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(sketch(docs), "near-sketches")
    named = sketches.where("n > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "bands", "filled")).alias("m")
    classes = stored(named.groupBy("k1", "k2", "n").agg(least).select("k1", "k2", "n", F.col("m.doc_id").alias("class_id"), F.col("m.bands").alias("bands"), F.col("m.filled").alias("filled")), "near-classes")

    index = classes.select("class_id", F.explode("bands").alias("key"))
    leads = stored(index.groupBy("key").agg(F.min("class_id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    stars = cut(index.join(leads, "key").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct())
    first = _confirmed(cut(_estimated(stars, classes)), docs)

    # Buckets of three or more that still hold several components: there are pairs that no star has tested.
    comps = cut(connected_components(first, "a", "b"))
    in_comp = stored(classes.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("comp", F.coalesce("component", "class_id")).drop("component"), "near-members")
    members = stored(in_comp.select("class_id", "comp", F.explode("bands").alias("key")).join(leads.where("size > 2").select("key"), "key"), "near-index")
    by_comp = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.max("c").alias("many"), F.sum("c").alias("size")).where("many < size")
    sizes = cut(sizes)
    rows = cut(members.join(sizes.select("key"), "key", "left_semi").select("key", "class_id", "comp"))
    ids = cut(rows.select(F.col("class_id").alias("doc_id")).distinct())
    sketched = _sets(docs, ids).withColumnRenamed("doc_id", "class_id").join(in_comp.select("class_id", "n", "bands", "filled"), "class_id")
    second = _within_blocks(rows, sizes, sketched)
    # The links found there join whole components, so only those are looked at again.
    joined = cut(connected_components(second, "a", "b"))
    named = in_comp.select("k1", "k2", "n", "comp").join(joined.withColumnRenamed("node", "comp"), "comp", "left")
    return sketches, cut(named.select("k1", "k2", "n", F.coalesce("component", "comp").alias("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept."""
    sketches, named = sketches_and_components(docs, id_col, text_col)
    rows = sketches.select("doc_id", "n", "k1", "k2")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL").join(named, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
