"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (labelled good), one of the raw corpus. A document's log
importance weight is the log ratio of the two for its features, averaged over them so that long documents are not all or nothing, at a
temperature; adding Gumbel noise and keeping the k greatest keys samples k documents without replacement in proportion to their weights.

The temperature is set by the labelled rows: 0 lies at the border that best parts them, and the median of the good ones ``LEAD`` nats
above it. So documents far from the border are kept or rejected almost surely, and the draw decides near it. k is not read off that border:
it is the number of good documents to be expected in the corpus, the sum of the logistic of all weights.

The raw model counts every document whole. Only labelled rows are sampled, by a hash of their id, up to ``LABELLED`` rows: one half
teaches the target model, the other half, whose words the model has not seen, sets the border.

Features are words and pairs of words, where a word is a maximal run of one kind of character (letters and other bytes from 0x80,
digits, marks), lower-cased. Noise comes from a hash of the id, so every run draws the same sample.

Defined results: null and empty texts have no features, and the weight of a mean log ratio of 0; rows of equal id and text get equal keys and are
kept or rejected together, as are all ties at the k-th key; without labelled rows of both kinds, or where the good ones do not lie above the border, everything is kept; null ids draw
like id 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import _SPACE, mix, span_hashes, strings, text_chunks, tidied, uniform
from graphloom.session import stored

BUCKETS, LABELLED, SMOOTHING, SEED = 1 << 16, 20_000, 4.0, 7
#: Nats between the border and the median good labelled document; the border counts a good document lost as so many bad passed.
LEAD, LOST = 6.0, 3.0

_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[_SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and pair of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    marks = np.flatnonzero(edge)
    starts, ends = marks[:-1], marks[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    hashes, rows = span_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1
    together = rows[1:] == rows[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[together]
    return (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[1:][together]])


@dataclass
class Ratio:
    """Log ratio of target and raw by bucket, its temperature (as a factor) and the weight of a mean of 0; ``scale`` 0 keeps everything."""

    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, rows = features(data, offsets, len(self.weights))
        n = len(offsets) - 1
        return self.scale * np.bincount(rows, self.weights[found], minlength=n) / np.maximum(1, np.bincount(rows, minlength=n)) + self.shift

    def keys(self, weights: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
        """Weights with Gumbel noise."""
        return weights - np.log(-np.log(uniform(ids, seed)))


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two models by bucket, each smoothed by as many counts, so that rare buckets say little either way."""
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)


def border_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that parts the two samples with the least sum of error rates, LOST times that of the good; the middle of its gap."""
    if not len(good) or not len(bad):
        return -math.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[int(np.argmin(LOST * lost + passed))])


def _bucket_counts(texts: DataFrame, group: str) -> DataFrame:
    """(g, bucket, n) from columns ``group`` and text; each chunk of texts is counted before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column(0))
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                found, rows = features(data, offsets)
                own = groups[lo:hi][rows]
                for g in np.unique(own):
                    sums.setdefault(int(g), np.zeros(BUCKETS, np.int64))
                    sums[int(g)] += np.bincount(found[own == g], minlength=BUCKETS)
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int64)), pa.array(at), pa.array(n[at])], names=["g", "bucket", "n"])

    return texts.select(F.col(group).cast("long").alias("g"), "text").mapInArrow(tidied(count), "g long, bucket long, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, good, text of at most ``most`` labelled rows; the sample's size is its bound, so it may be broadcast."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("good")).where("_id IS NOT NULL AND good IS NOT NULL")
    rows = rows.groupBy("_id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("doc_id", "good", "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    sample = labelled_sample(docs, labels, label_col, most, id_col, text_col)
    teaches = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    everything = docs.select(F.lit(0).alias("g"), F.col(text_col).alias("text"))
    for counts, texts, group in ((raw, everything, "g"), (target, sample.where(teaches & (F.col("good") == 1)), "good")):
        for _, bucket, n in _bucket_counts(texts, group).collect():  # at most BUCKETS rows
            counts[bucket] += n
    model = Ratio(log_ratio(target, raw))
    judged = sample.where(~teaches)
    good, bad = (np.array([w for (w,) in weigh(judged.where(F.col("good") == g), model).select("log_weight").collect()]) for g in (1, 0))  # at most ``most`` rows
    return tempered(model, good, bad) if target.sum() else Ratio(model.weights, 0.0)


def tempered(model: Ratio, good: np.ndarray, bad: np.ndarray) -> Ratio:
    """``model`` at the temperature that the means of labelled documents ask for."""
    border = border_between(good, bad)
    above = float(np.median(good)) - border if math.isfinite(border) else 0.0
    return Ratio(model.weights, LEAD / above, -LEAD / above * border) if above > 0 else Ratio(model.weights, 0.0)


def sample_size(weighed: DataFrame, model: Ratio) -> int:
    """The number of good documents to be expected: the sum of the logistic of all weights (in whole millionths, so that its order does not matter)."""
    if not model.scale:
        return weighed.count()
    share = F.round(1e6 / (1 + F.exp(-F.col("log_weight")))).cast("long")
    return round((weighed.agg(F.sum(share)).first()[0] or 0) / 1e6)


def weigh(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and the Gumbel key of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).fill_null(0)).astype(np.int64)
            for lo, hi, data, offsets in text_chunks(strings(batch.column(1))):
                weights = model(data, offsets)
                keys = model.keys(weights, ids[lo:hi], seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(weights), pa.array(keys)], names=["doc_id", "log_weight", "key"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(tidied(run), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, log_weight double, key double")


def kth_greatest(rows: DataFrame, column: str, k: int, parts: int = 4096) -> float:
    """The k-th greatest value, exactly: each round counts the values in ``parts`` slices and goes on in the one that holds it."""
    if k <= 0:
        return math.inf
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -math.inf
    while low < high:
        width = (high - low) / parts
        if not width > 0 or low + width == low:
            break
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1))
        counts = dict(rows.where(F.col(column).between(low, high)).groupBy(slot.alias("s")).count().collect())  # at most ``parts`` rows
        for s in sorted(counts, reverse=True):
            if counts[s] >= k:
                break
            k -= counts[s]
        inside = rows.where(F.col(column).between(low, high) & (slot == s))
        new_low, new_high = inside.agg(F.min(column), F.max(column)).first()
        if (new_low, new_high) == (low, high):
            break
        if counts[s] <= parts:
            return sorted((v for (v,) in inside.select(column).collect()), reverse=True)[k - 1]
        low, high = new_low, new_high
    return low


def resample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key and kept of every document."""
    model = fit(docs, labels, label_col, most, id_col, text_col)
    weighed = stored(weigh(docs, model, id_col, text_col, seed), "quality-weights")
    return weighed.withColumn("kept", F.col("key") >= kth_greatest(weighed, "key", sample_size(weighed, model)))


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """The kept rows of ``docs`` with all their columns. Keys are computed again where the rows stand, so no text is shuffled."""
    model = fit(docs, labels, label_col, most, id_col, text_col)
    weighed = stored(weigh(docs, model, id_col, text_col, seed), "quality-weights")
    least = kth_greatest(weighed, "key", sample_size(weighed, model))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(at_id).fill_null(0)).astype(np.int64)
            for lo, hi, data, offsets in text_chunks(strings(batch.column(at_text))):
                keys = model.keys(model(data, offsets), ids[lo:hi], seed)
                yield batch.slice(lo, hi - lo).filter(pa.array(keys >= least))

    return docs.mapInArrow(tidied(run), docs.schema)
