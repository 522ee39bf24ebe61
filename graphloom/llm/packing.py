"""Packing of whole texts into training sequences by lexical retrieval.

The corpus is cut into shards of consecutive rows, each with an inverted BM25 index of its own that is built, asked and dropped in
one task, so no text is shuffled and memory is bounded by the shard. A seed document opens a sequence; the index returns its unused
neighbours in the order of their scores and they fill the window greedily; where none is left that shares a telling word, the shard's
next unused documents follow, as a window is not left open. The last one is cut where the window ends and its rest
seeds the next sequence; so only the last sequence of a shard is padded. Documents longer than a window fill windows of their own
first.

Defined results: null text counts as empty and still gets its end id; repeated rows are packed as often as they occur; columns other
than id and text are ignored; an empty table gives no rows; ties between neighbours go to the earlier row. Sequence ids are unique
over the result (task number and running number).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.byte_bpe import vocabulary_file
from graphloom.llm.common import runs, text_chunks, tidied, word_hashes
from graphloom.llm.unit_encoder import UnitEncoder

WINDOW, END_ID, SHARD_BYTES = 2048, 1, 6 << 20
#: Bytes of text encoded at once.
CHUNK_BYTES = 1 << 19
#: The usual constants of BM25.
K1, B = 1.2, 0.75

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 postings of one shard, in memory."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray, n: int):
        self.n = n
        lengths = np.bincount(rows, minlength=n)
        # Words by hash and then document, as documents are in order; equal neighbours are one posting.
        order = np.argsort(hashes, kind="stable").astype(np.uint32)
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        terms = np.cumsum(fresh, dtype=np.int32) - 1
        del order, hashes
        fresh[1:] |= rows[1:] != rows[:-1]
        at = np.flatnonzero(fresh)
        counts = np.diff(at, append=len(fresh))
        self.docs, terms = rows[at], terms[at]
        del rows, fresh, at
        size = int(terms[-1]) + 1 if len(terms) else 0
        frequency = np.bincount(terms, minlength=size)
        # A term in over half of the documents tells nothing: its weight is 0 and its list need not be read.
        idf = np.maximum(0.0, np.log((n - frequency + 0.5) / (frequency + 0.5)))
        norm = K1 * (1 - B + B * lengths[self.docs] / max(1.0, lengths.mean()))
        self.impact = (idf[terms] * counts * (K1 + 1) / (counts + norm)).astype(np.float32)
        del norm, counts
        self.begin = np.concatenate([[0], np.cumsum(frequency)])
        order = np.argsort(self.docs, kind="stable").astype(np.uint32)
        useful = (idf[terms] > 0) & (frequency[terms] > 1)
        order = order[useful[order]]
        self.terms_of = terms[order]
        self.term_at = np.searchsorted(self.docs[order], np.arange(n + 1))

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms_of[self.term_at[doc] : self.term_at[doc + 1]]
        if not len(terms):
            return np.zeros(self.n)
        begin, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[at], self.impact[at], minlength=self.n)


def pack_shard(sizes: list[int], scores, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; ``scores(doc)`` rates all documents of the shard."""
    n, sequence = len(sizes), 0
    unused, start = np.ones(n, bool), [0] * n
    seed, scan = -1, 0
    while True:
        if seed < 0:
            while scan < n and not unused[scan]:
                scan += 1
            if scan == n:
                return
            seed = scan
            unused[seed] = False
        while sizes[seed] - start[seed] >= window:
            yield seed, start[seed], window, sequence, 0
            start[seed] += window
            sequence += 1
        filled = sizes[seed] - start[seed]
        if not filled:
            seed = -1
            continue
        yield seed, start[seed], filled, sequence, 0
        nearest = iter(np.argsort(-np.where(unused, scores(seed), -1.0), kind="stable")[: int(unused.sum())].tolist())
        seed = -1
        for doc in nearest:
            unused[doc] = False
            take = min(window - filled, sizes[doc])
            yield doc, 0, take, sequence, filled
            filled, start[doc] = filled + take, take
            if take < sizes[doc]:
                seed = doc
            if filled == window:
                break
        sequence += 1


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary, with ``with_ids``)."""

    def pieces(held: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of one shard, from parts (which it clears): (document ids, token ids, sizes in tokens, word hashes, words of each document)."""
        ids = pa.concat_arrays([h[0] for h in held])
        tokens, sizes, hashes, words = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        held.clear()
        index = Index(hashes, np.repeat(np.arange(len(words), dtype=np.int32), words), len(sizes))
        made = list(pack_shard(sizes.tolist(), index.scores, window))
        del index, hashes
        doc, start, length, sequence, offset = np.array(made, np.int64).T
        begin = (np.cumsum(sizes) - sizes)[doc] + start
        bare = memoryview(tokens).cast("B")
        columns = {
            "doc_id": ids.take(pa.array(doc)),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(bare[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64()),
            "doc_tokens": pa.array(sizes[doc]),
            "sequence_id": pa.array(sequence + first),
            "offset": pa.array(offset),
        }
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
            columns["ids"] = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(tokens[runs(begin, length)])])
        return pa.RecordBatch.from_pydict(columns), first + int(sequence[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = UnitEncoder(vocabulary_file(vocabulary), pattern, END_ID)
        first = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                tokens, ends = coder.encode(data, offsets)
                hashes, rows = word_hashes(data, offsets)
                held.append((batch.column(0).slice(lo, hi - lo), tokens, np.diff(ends, prepend=0), hashes, np.bincount(rows, minlength=hi - lo)))
                size += len(data)
                if size >= shard_bytes:
                    out, first = pieces(held, first)
                    size = 0
                    yield out
        if held:
            yield pieces(held, first)[0]

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tidied(run), f"doc_id {kind}, {SCHEMA}" + ", ids binary" * with_ids)
