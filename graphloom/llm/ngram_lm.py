"""Language-model scores from a sharded Elias-Fano n-gram trie.

The trie's first level is the vocabulary (sorted 64-bit word hashes with exact counts). Each further level holds, for every node of the
level above, the sorted word ids that follow it, made monotone by adding the last value of the range before, and coded in Elias-Fano
form, as are the pointers to each node's range. Beside each id lies its smoothed probability in 8 bits. A query follows a context down
and searches the word's successor within the context's own range.

Shards are ranges of the first two words. Their borders come from the word counts, so that each shard has about the same share of the
text, and a very frequent first word is itself cut between shards. Counting tasks send each shard sorted arrays of distinct n-grams
with their counts; one task builds one shard and writes it to the shared folder, from where scoring tasks map it into memory.

Smoothing: interpolated absolute discounting with three discounts a level, estimated for each shard from its counts of counts. The
lowest order is the add-one-half unigram estimate with one place for unknown words.

Shards lie in the shared folder, whatever store that is. Where it is mounted as a path they are mapped from there; otherwise a machine
fetches the shards that its tasks ask for into a local cache, which is lost with the machine and fetched again by the next. A task opens
a shard when a block of texts first asks it. The driver holds one number for each shard, and one shard of the vocabulary at a time.

Defined results: null text counts as empty, which is one end token; repeated rows repeat; other columns are ignored; without training
rows every word is unknown; an empty table gives no rows; null ids count as training rows.
"""

from __future__ import annotations

import ast
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import strings, text_chunks, tidied, word_hashes
from graphloom.session import dropped_at_exit, new_path

ORDER = 3
#: Words handled at once, words of text for each shard, and the range of -log10 that 8 bits hold for probabilities and weights.
BLOCK_WORDS, SHARD_WORDS, PROB_RANGE, WEIGHT_RANGE = 1 << 20, 3_000_000, 8.0, 3.0
#: The end token's place among word hashes.
END = np.uint64(0x5EED0FE2D0000001)
_U = np.uint64


# --- Elias-Fano sequences ---------------------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of unsigned integers; arrays may be memory-mapped."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ranks = n, bits, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(_U)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            part = values & _U((1 << bits) - 1)
            # Positions are ascending, so what falls in one word is a run of them.
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift + _U(bits) > _U(64))
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        places = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = ((int(places[-1]) if n else 0) + 2 + 63) // 64 * 64
        flags = np.zeros(size, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, bits, low, high, ranks)

    def _in_word(self, words: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) set bit of each word."""
        place = np.zeros(len(words), np.int64)
        nth = nth.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = words & _U((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            up = nth >= ones
            nth = nth - np.where(up, ones, 0)
            place += np.where(up, width, 0)
            words = np.where(up, words >> _U(width), part)
        return place

    def _select(self, nth: np.ndarray, zeros: bool) -> np.ndarray:
        ranks = self.ranks
        if zeros:
            before = np.arange(len(ranks), dtype=np.int64) * 64 - ranks if not hasattr(self, "_zeros") else self._zeros
            self._zeros = before
            word = np.searchsorted(before, nth, "right") - 1
            return word * 64 + self._in_word(~self.high[word], nth - before[word])
        word = np.searchsorted(ranks, nth.astype(np.uint32), "right") - 1
        return word * 64 + self._in_word(self.high[word], nth - ranks[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        value = self.low[word] >> shift
        over = shift + _U(self.bits) > _U(64)
        value = np.where(over, value | (self.low[word + 1] << ((_U(64) - shift) & _U(63))), value)
        return value & _U((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return ((self._select(i, False) - i).astype(_U) << _U(self.bits)) | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each value within [begin, end), or -1: a successor search that has to hit."""
        found = np.full(len(values), -1, np.int64)
        if not self.n:
            return found
        highest = len(self.high) * 64 - self.n - 1
        part = (values >> _U(self.bits)).astype(np.int64)
        ask = np.flatnonzero((begin < end) & (part <= highest))
        part, low = part[ask], values[ask] & _U((1 << self.bits) - 1)
        start = np.where(part > 0, self._select(np.maximum(part - 1, 0), True) - part + 1, 0)
        stop = np.minimum(self._select(part, True) - part, end[ask])
        start = np.maximum(start, begin[ask])
        last = stop
        while True:
            on = np.flatnonzero(start < stop)
            if not len(on):
                break
            middle = (start[on] + stop[on]) // 2
            less = self._low(middle) < low[on]
            start[on] = np.where(less, middle + 1, start[on])
            stop = stop.copy()
            stop[on] = np.where(less, stop[on], middle)
        hit = np.flatnonzero(start < np.minimum(last, self.n))
        hit = hit[self._low(start[hit]) == low[hit]]
        found[ask[hit]] = start[hit]
        return found

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ranks": self.ranks}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.meta"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ranks"])


def packed(arrays: dict[str, np.ndarray]) -> Iterator[bytes]:
    """Named arrays as one file: a head of names, types and places, then the arrays."""
    head, at = [], 0
    for name, array in arrays.items():
        head.append((name, array.dtype.str, len(array), at))
        at += -(-array.nbytes // 8) * 8
    text = repr(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    yield len(text).to_bytes(8, "little") + text
    for array in arrays.values():
        yield array.tobytes() + b"\0" * (-array.nbytes % 8)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = ast.literal_eval(data[8 : 8 + size].tobytes().decode())
    return {name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in head}


class Store:
    """Files of arrays below a folder that driver and executors share."""

    def __init__(self, uri: str):
        self.uri = uri if urlparse(uri).scheme else f"file://{os.path.abspath(uri)}"

    def _there(self) -> tuple[pa_fs.FileSystem, str]:
        return pa_fs.FileSystem.from_uri(self.uri)

    def make(self) -> None:
        fs, root = self._there()
        fs.create_dir(root, recursive=True)

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """One file, put in place at once; a repeated task writes the same again."""
        fs, root = self._there()
        rough = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(rough) as out:
            for part in packed(arrays):
                out.write(part)
        fs.move(rough, f"{root}/{name}")

    def open(self, name: str) -> dict[str, np.ndarray]:
        fs, root = self._there()
        if isinstance(fs, pa_fs.LocalFileSystem):
            return map_arrays(f"{root}/{name}")
        cache = os.path.join(tempfile.gettempdir(), "ngrams-" + hashlib.sha256(self.uri.encode()).hexdigest()[:24])
        own = os.path.join(cache, name)
        if not os.path.exists(own):
            os.makedirs(cache, exist_ok=True)
            rough = f"{own}.{uuid.uuid4().hex}"
            with fs.open_input_stream(f"{root}/{name}") as source, open(rough, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            os.replace(rough, own)
        return map_arrays(own)


# --- Counting ---------------------------------------------------------------------------------------------------------------------


def token_blocks(batches: Iterator[pa.RecordBatch], column: int, words: int = BLOCK_WORDS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(held batches' slices, token hashes with an end after each text, text's number) of about ``words`` tokens at a time."""
    held, hashes, rows, n, size = [], [], [], 0, 0
    for batch in batches:
        texts = strings(batch.column(column))
        for lo, hi, data, offsets in text_chunks(texts):
            h, r = word_hashes(data, offsets)
            ends = np.searchsorted(r, np.arange(hi - lo), "right")
            hashes.append(np.insert(np.where(h == END, h + _U(1), h), ends, END))
            rows.append(np.insert(r, ends, np.arange(hi - lo)) + n)
            held.append(batch.slice(lo, hi - lo))
            n, size = n + hi - lo, size + len(hashes[-1])
            if size >= words:
                yield held, np.concatenate(hashes), np.concatenate(rows)
                held, hashes, rows, n, size = [], [], [], 0, 0
    if held:
        yield held, np.concatenate(hashes), np.concatenate(rows)


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Unsigned 32-bit arrays of ids or counts and 64-bit arrays, byte planes apart, compressed."""
    out = b"".join(np.array([len(a), a.dtype.itemsize], np.int64).tobytes() + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(out)


def unsqueezed(blob: bytes) -> list[np.ndarray]:
    data, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), [], 0
    while at < len(data):
        n, size = data[at : at + 16].view(np.int64).tolist()
        at += 16
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(np.uint32 if size == 4 else _U).ravel())
        at += n * size
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, their summed counts, and each input row's place among them."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, minlength=len(found)).astype(np.int64), place


class Vocabulary:
    """Sorted word hashes and counts, in one file for each range of hashes; a word's id is its place.

    ``shards`` lists (name, first hash, words, tokens) of each file.
    """

    def __init__(self, store: Store, shards: list[tuple[str, int, int, int]]):
        self.store, self.names = store, [s[0] for s in shards]
        self.first = np.array([s[1] for s in shards], _U)
        self.starts = np.cumsum([0, *(s[2] for s in shards)])
        self.running = np.cumsum([0, *(s[3] for s in shards)])
        self.size, self.total = int(self.starts[-1]), int(self.running[-1])
        self.bits = max(1, (self.size + 1).bit_length())
        self.held: dict[int, dict[str, np.ndarray]] = {}

    def shard(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.held:
            self.held[i] = self.store.open(self.names[i])
        return self.held[i]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each of the ascending distinct hashes; an unknown word has id ``size`` and count 0."""
        ids, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        borders = [*np.searchsorted(hashes, self.first).tolist(), len(hashes)]
        for i, (start, a, b) in enumerate(zip(self.starts.tolist(), borders, borders[1:], strict=False)):
            if a < b:
                shard = self.shard(i)
                at = np.minimum(np.searchsorted(shard["hash"], hashes[a:b]), len(shard["hash"]) - 1)
                hit = shard["hash"][at] == hashes[a:b]
                ids[a:b][hit], counts[a:b][hit] = start + at[hit], shard["count"][at[hit]]
        return ids, counts

    def counts(self, low: int, high: int) -> np.ndarray:
        """Counts of the words from id ``low`` to ``high``."""
        first, last = np.searchsorted(self.starts, [low, high], "right") - 1
        return np.concatenate([self.shard(i)["count"][max(0, low - o) : high + 1 - o] for i, o in zip(range(first, last + 1), self.starts[first:].tolist())])

    def _at(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of the word over which the running count of tokens passes, by what share of its count) for ascending numbers of tokens."""
        ids, within = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        place = np.minimum(np.searchsorted(self.running, tokens, "right") - 1, len(self.names) - 1)
        for i in np.unique(place).tolist():
            mine = np.flatnonzero(place == i)
            running = np.concatenate([[0], np.cumsum(self.store.open(self.names[i])["count"])])
            left = tokens[mine] - self.running[i]
            at = np.minimum(np.searchsorted(running, left, "right") - 1, len(running) - 2)
            ids[mine], within[mine] = self.starts[i] + at, (left - running[at]) / (running[at + 1] - running[at])
        return ids, within

    def borders(self, parts: int) -> np.ndarray:
        """Keys (first id, second id) that cut the text's word pairs into about equal parts, going by the counts of single words."""
        if not self.size:
            return np.zeros(0, np.int64)
        first, within = self._at(self.total * np.arange(1, parts) // parts)
        order = np.argsort(within, kind="stable")
        second = np.zeros(len(first), np.int64)
        second[order] = self._at((within[order] * self.total).astype(np.int64))[0]
        return np.unique((first << self.bits) | second)


def count_words(texts: DataFrame, store: Store, parts: int) -> Vocabulary:
    """Write the vocabulary of the column ``text``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, _ in token_blocks(batches, 0):
            found, counts = np.unique(hashes, return_counts=True)
            edges = np.searchsorted(found, (np.arange(1, parts) * (2**64 // parts)).astype(_U) if parts > 1 else np.zeros(0, _U))
            cut = [0, *edges.tolist(), len(found)]
            rows = [(s, squeezed([found[a:b], counts[a:b].astype(np.uint32)])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        shard, got = table.column("shard")[0].as_py(), [unsqueezed(b.as_py()) for b in table.column("blob")]
        found, counts, _ = summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        store.write(name := f"vocab-{shard:06d}", {"hash": found, "count": counts})
        return pa.table({"name": [name], "first": found[:1].view(np.int64), "words": [len(found)], "tokens": [int(counts.sum())]})

    made = texts.mapInArrow(tidied(send), "shard int, blob binary").groupBy("shard").applyInArrow(merge, "name string, first long, words long, tokens long")
    return Vocabulary(store, sorted((r.name, r.first % 2**64, r.words, r.tokens) for r in made.collect()))  # a row for each shard


def discounts(counts: np.ndarray) -> np.ndarray:
    """What to take off counts of 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (float((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0.1, 0.2, 0.3], [0.97, 1.9, 2.8])


def coded(values: np.ndarray, span: float) -> np.ndarray:
    """Values in (0, 1] as 8-bit steps of -log10; 255 is zero."""
    with np.errstate(divide="ignore"):
        return np.where(values > 0, np.clip(np.rint(-np.log10(values) * (254 / span)), 0, 254), 255).astype(np.uint8)


def decoded(span: float) -> np.ndarray:
    return np.append(10.0 ** (-np.arange(255) * (span / 254)), 0.0)


def count_ngrams(texts: DataFrame, vocabulary: Vocabulary, order: int, borders: np.ndarray) -> list[tuple[int, int, int]]:
    """Write one trie for each range of first two words; (shard, lowest, highest first word) of each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = vocabulary.bits
        for _, hashes, rows in token_blocks(batches, 0):
            found, place = np.unique(hashes, return_inverse=True)
            ids = vocabulary.look_up(found)[0][place]
            above, levels = ids, []
            for k in range(2, order + 1):
                # Grams of k words begin where k words remain in the same text.
                start = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
                keys, place, counts = np.unique((above[start] << bits) | ids[start + k - 1], return_inverse=True, return_counts=True)
                above = np.zeros(len(ids), np.int64)
                above[start] = place
                levels.append((keys, counts))
            cut = [0, *np.searchsorted(levels[0][0], borders).tolist(), len(levels[0][0])]
            slices, made = [cut], [[] for _ in cut[1:]]
            for k, (keys, counts) in enumerate(levels):
                if k:
                    cut = np.searchsorted(keys >> bits, slices[-1]).tolist()
                    slices.append(cut)
                for s, (a, b) in enumerate(zip(cut, cut[1:])):
                    parent = (keys[a:b] >> bits) - (slices[k - 1][s] if k else 0)
                    made[s] += [parent.astype(_U if k == 0 else np.uint32), (keys[a:b] & ((1 << bits) - 1)).astype(_U if bits > 32 else np.uint32), counts[a:b].astype(np.uint32)]
            rows_out = [(s, squeezed(m)) for s, m in enumerate(made) if len(m[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_out], pa.int32()), pa.array([r[1] for r in rows_out], pa.binary())], names=["shard", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        shard, got = table.column("shard")[0].as_py(), [unsqueezed(b.as_py()) for b in table.column("blob")]
        bits, mask = vocabulary.bits, (1 << vocabulary.bits) - 1
        arrays: dict[str, np.ndarray] = {}
        places: list[np.ndarray] = [None] * len(got)
        for level in range(2, order + 1):
            at = 3 * (level - 2)
            keys = np.concatenate([((g[at].astype(np.int64) if level == 2 else places[i][g[at]]) << bits) | g[at + 1].astype(np.int64) for i, g in enumerate(got)])
            keys, counts, place = summed(keys, np.concatenate([g[at + 2] for g in got]))
            ends = np.cumsum([len(g[at]) for g in got])
            places = np.split(place, ends[:-1])
            parents, ids = keys >> bits, keys & mask
            if level == 2:
                low, high = int(parents[0]), int(parents[-1])
                arrays["range"] = np.array([low, high], np.int64)
                size = high - low + 1
                context = vocabulary.counts(low, high).astype(float)
                parents = parents - low
            else:
                size, context = len(last), last.astype(float)
            taken = discounts(counts)[np.minimum(counts, 3) - 1]
            arrays[f"{level}.prob"] = coded((counts - taken) / context[parents], PROB_RANGE)
            arrays[f"{level - 1}.weight"] = coded(np.bincount(parents, taken, minlength=size) / np.maximum(context, 1), WEIGHT_RANGE)
            begin = np.searchsorted(parents, np.arange(size + 1))
            ends = begin[1:]
            # Each range goes on from the last value of the one before.
            tail = np.where(ends > begin[:-1], ids[np.maximum(ends, 1) - 1] + 1, 0)
            base = np.concatenate([[0], np.cumsum(tail)])[:-1]
            arrays |= EliasFano.build(ids + base[parents]).parts(f"{level}.ids") | EliasFano.build(begin).parts(f"{level}.begin")
            last = counts
        vocabulary.store.write(f"trie-{shard:06d}", arrays)
        return pa.table({"shard": pa.array([shard], pa.int32()), "low": arrays["range"][:1], "high": arrays["range"][1:]})

    made = texts.mapInArrow(tidied(send), "shard int, blob binary").groupBy("shard").applyInArrow(merge, "shard int, low long, high long")
    return sorted((r.shard, r.low, r.high) for r in made.collect())  # a row for each shard


# --- Scoring ----------------------------------------------------------------------------------------------------------------------


class Trie:
    """One shard, mapped into memory."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.low, self.high = arrays["range"].tolist()
        self.ids = {k: EliasFano.of(arrays, f"{k}.ids") for k in range(2, order + 1)}
        self.begin = {k: EliasFano.of(arrays, f"{k}.begin") for k in range(2, order + 1)}
        self.prob = {k: arrays[f"{k}.prob"] for k in range(2, order + 1)}
        self.weight = {k: arrays[f"{k}.weight"] for k in range(1, order)}

    def find(self, level: int, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Nodes of ``level`` below the given nodes (level 2: below first words, as ids), or -1."""
        found = np.full(len(parents), -1, np.int64)
        ask = np.flatnonzero((parents >= self.low) & (parents <= self.high) if level == 2 else parents >= 0)
        node = parents[ask] - (self.low if level == 2 else 0)
        pointers, values = self.begin[level], self.ids[level]
        begin, end = pointers[node].astype(np.int64), pointers[node + 1].astype(np.int64)
        some = np.flatnonzero(begin < end)
        ask, begin, end = ask[some], begin[some], end[some]
        # The range's base is one more than the value before it.
        base = np.where(begin > 0, values[np.maximum(begin - 1, 0)] + _U(1), _U(0)) if len(begin) else np.zeros(0, _U)
        found[ask] = values.find(base + ids[ask].astype(_U), begin, end)
        return found


class Model:
    """The whole trie as scoring tasks see it."""

    def __init__(self, vocabulary: Vocabulary, shards: list[tuple[int, int, int]], order: int):
        self.order, self.vocabulary, self.shards = order, vocabulary, shards
        self.tries: dict[int, Trie] = {}
        self.probs, self.weights = decoded(PROB_RANGE), decoded(WEIGHT_RANGE)

    def trie(self, number: int) -> Trie:
        if number not in self.tries:
            self.tries[number] = Trie(self.vocabulary.store.open(f"trie-{number:06d}"), self.order)
        return self.tries[number]

    def log_probs(self, hashes: np.ndarray, rows: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, base log10 probability, log10 probability) of each token."""
        v = self.vocabulary
        found, place = np.unique(hashes, return_inverse=True)
        word_ids, word_counts = v.look_up(found)
        ids, counts = word_ids[place], word_counts[place]
        base = (counts + 0.5) / (v.total + 0.5 * (v.size + 1))
        p = base.copy()
        first, first_place = np.unique(word_ids, return_inverse=True)
        weight = np.zeros(len(first))
        seen = np.zeros(len(first), bool)
        lows, highs = (np.array([s[i] for s in self.shards], np.int64) for i in (1, 2))
        begin, end = np.searchsorted(first, lows), np.searchsorted(first, highs, "right")
        for i in np.flatnonzero(begin < end).tolist():
            trie, a, b = self.trie(self.shards[i][0]), int(begin[i]), int(end[i])
            part = self.weights[trie.weight[1][first[a:b] - trie.low]]
            weight[a:b] += part
            seen[a:b] |= part > 0
        context_weight = np.where(seen, weight, 1.0)[first_place][place]
        above, above_nodes = ids, None
        for k in range(2, self.order + 1):
            start = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
            keys, gram = np.unique((above[start] << v.bits) | ids[start + k - 1], return_inverse=True)
            parents, last = keys >> v.bits, keys & ((1 << v.bits) - 1)
            if k == 2:
                cut = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
            else:
                cut, parents = np.searchsorted(parents, cut).tolist(), above_nodes[parents]
            nodes, prob, own_weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
            for number, _, _ in self.shards:
                a, b = cut[number], cut[number + 1]
                if a < b:
                    trie = self.trie(number)
                    at = trie.find(k, parents[a:b], last[a:b])
                    hit = np.flatnonzero(at >= 0)
                    nodes[a:b] = at
                    prob[a + hit] = self.probs[trie.prob[k][at[hit]]]
                    if k < self.order:
                        w = self.weights[trie.weight[k][at[hit]]]
                        own_weight[a + hit] = np.where(w > 0, w, 1.0)
            end = start + k - 1
            p[end] = prob[gram] + context_weight[start] * p[end]
            context_weight = np.ones(len(ids))
            context_weight[start] = own_weight[gram]
            above = np.zeros(len(ids), np.int64)
            above[start] = gram
            above_nodes = nodes
        return counts, np.log10(base), np.log10(np.minimum(p, 1.0))


def score_documents(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text, by a model of the texts of ``train``."""
    spark = docs.sparkSession
    store = Store(new_path(spark, "ngrams"))
    store.make()
    dropped_at_exit(spark, store.uri)
    texts = train.select(F.col(text_col).alias("text"))
    parts = max(8, texts.rdd.getNumPartitions())
    vocabulary = count_words(texts, store, parts)
    borders = vocabulary.borders(max(parts, -(-vocabulary.total // shard_words)))
    vocabulary.held.clear()
    shards = count_ngrams(texts, vocabulary, order, borders) if vocabulary.size else []
    total = vocabulary.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(vocabulary, shards, order)
        for held, hashes, rows in token_blocks(batches, 1, BLOCK_WORDS // 2):
            counts, base, score = model.log_probs(hashes, rows, borders)
            n = sum(h.num_rows for h in held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([h.column(0) for h in held]),
                    pa.array(np.bincount(rows, minlength=n)),
                    pa.array(np.bincount(rows, counts > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, total, np.int64)),
                    pa.array(np.bincount(rows, base, minlength=n)),
                    pa.array(np.bincount(rows, score, minlength=n)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
