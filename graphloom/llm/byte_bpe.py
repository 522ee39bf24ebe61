"""Byte-level BPE encoding and decoding on padded numpy matrices.

Distinct pre-tokens of similar length share a matrix, one row each, padded with -1. Every round looks all adjacent pairs of new
neighbours up in a hashed pair table, merges each row's leftmost pair of least rank and closes the gap; rows without a pair leave the
matrix. A text is first cut before each space that a non-space follows, which is always a border of the pre-token pattern, so the
ids of such units can be kept between texts.

Defined results: null text counts as empty (no ids, hashes of the empty string); repeated rows give repeated results; columns other
than id and text are ignored; an empty table gives no rows. A very long text or pre-token needs memory in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import strings

#: Units kept between texts by one worker; beyond that it starts afresh, which changes no result.
CACHE_UNITS = 400_000
_NONE = np.int64(1 << 40)
_SHIFT = np.int64(20)


def vocabulary_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps ``name``."""
    return importlib.import_module("public_tokenizers").path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open addressing over (left id, right id), looked up for whole arrays at once."""

    def __init__(self, pairs: np.ndarray, values: np.ndarray):
        self.mask = np.int64((1 << max(4, int(2 * len(pairs)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.values = np.full(int(self.mask) + 1, _NONE, np.int64)
        waiting, at = np.arange(len(pairs)), self._slot(pairs)
        while len(waiting):
            free = self.keys[at] == -1
            self.keys[at[free]] = pairs[waiting[free]]  # of rivals for a slot the last one written stays
            won = self.keys[at] == pairs[waiting]
            self.values[at[won]] = values[waiting[won]]
            waiting, at = waiting[~won], (at[~won] + 1) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        x = pairs * np.int64(-7046029254386353131)
        return (x ^ (x >> np.int64(29))) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id, which is also the rank, or _NONE."""
        pairs = np.where((left < 0) | (right < 0), np.int64(-2), (left << _SHIFT) | right)
        found = np.full(pairs.shape, _NONE, np.int64)
        flat, out = pairs.ravel(), found.ravel()
        waiting = np.flatnonzero(flat >= 0)
        at = self._slot(flat[waiting])
        while len(waiting):
            there = self.keys[at]
            hit = there == flat[waiting]
            out[waiting[hit]] = self.values[at[hit]]
            on = ~hit & (there != -1)
            waiting, at = waiting[on], (at[on] + 1) & self.mask
        return out.reshape(pairs.shape)


class ByteBPE:
    """Encodes and decodes by a rank file: a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(ranks[a], ranks[b], r) for token, r in ranks.items() if len(token) > 1 for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        left, right, merged = np.array(pairs or [(0, 0, 0)], np.int64).T
        self.pairs = PairTable((left << _SHIFT) | right, merged if pairs else np.full(1, _NONE))
        self.border, self.odd = regex.compile(r" (?=\S)"), regex.compile(r" (?:\s|$)")
        self.known: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def merge_rows(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each token (of similar lengths) as merged from single bytes, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        filled = np.arange(lengths.max())[None, :] < lengths[:, None]
        ids = np.full(filled.shape, -1, np.int64)
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        done: list[bytes] = [b""] * len(tokens)
        rows = np.arange(len(tokens))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                over = best == _NONE
            else:
                over = np.ones(len(rows), bool)
            if over.any():
                full = ids[over].astype("<u4")
                sizes, raw, step = ((ids[over] >= 0).sum(1) * 4).tolist(), full.tobytes(), 4 * full.shape[1]
                for i, (row, size) in enumerate(zip(rows[over].tolist(), sizes, strict=True)):
                    done[row] = raw[i * step : i * step + size]
                on = ~over
                rows, ids, ranks = rows[on], ids[on], ranks[on]
                if not len(rows):
                    break
                at, best = at[on], best[on]
            every, width = np.arange(len(rows)), ids.shape[1]
            ids[every, at] = best
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            for side in (at - 1, at):  # only the pairs on either side of the merged token have changed
                ok = (side >= 0) & (side < width - 2)
                r, c = every[ok], side[ok]
                ranks[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
        return done

    def encode_pretokens(self, tokens: list[str]) -> None:
        """Make each distinct pre-token's ids known."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for token in tokens:
            raw = token.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.tokens[token] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault((len(raw) + 1) // 2 if len(raw) <= 24 else 12 + (len(raw) - 1).bit_length(), []).append((token, raw))
        for members in buckets.values():
            step = max(1, (1 << 18) // max(len(raw) for _, raw in members))
            for i in range(0, len(members), step):
                part = members[i : i + step]
                self.tokens.update(zip([token for token, _ in part], self.merge_rows([raw for _, raw in part]), strict=True))

    def units(self, text: str) -> list[str]:
        """Consecutive pieces of the text, cut before each space that a non-space follows; no pre-token crosses their borders."""
        first, *rest = self.border.split(text) if self.odd.search(text) else text.split(" ")
        return [first, *[" " + unit for unit in rest]]

    def encode_missing(self, units: list[str]) -> None:
        # Units that begin with a space stay apart when joined, so one search cuts them all.
        joined, rest = [u for u in units if u[:1] == " " and u[1:2].strip()], [u for u in units if not (u[:1] == " " and u[1:2].strip())]
        cut = self.pattern.findall("".join(joined))
        parts = [self.pattern.findall(unit) for unit in rest]
        wanted = set(cut).union(*parts)
        missing = wanted - self.tokens.keys()
        if len(self.tokens) + len(missing) > CACHE_UNITS:
            self.tokens.clear()
            missing = wanted
        self.encode_pretokens(list(missing))
        ids, known, at = self.tokens, self.known, 0
        for unit in joined:
            left, size = b"", len(unit)
            while size > 0:
                token = cut[at]
                left += ids[token]
                size -= len(token)
                at += 1
            known[unit] = left
        for unit, tokens in zip(rest, parts, strict=True):
            known[unit] = b"".join([ids[token] for token in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.units(text) for text in texts]
        wanted = set().union(*split) if split else set()
        missing = wanted - self.known.keys()
        if len(self.known) + len(missing) > CACHE_UNITS:
            self.known.clear()
            missing = wanted
        self.encode_missing(list(missing))
        return [b"".join(map(self.known.__getitem__, units)) for units in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most or i + 1 == len(texts):
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every whole text.

    ``vocabulary`` is the name of a rank file in the public vocabulary package; every executor resolves it on its own machine.
    """
    return _mapped(docs, vocabulary, pattern, id_col, text_col, "ids binary, decoded binary", lambda bpe, ids: (ids, bpe.decode(ids)))


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, hashed beside the coder so that ids never leave the worker."""

    def digest(bpe: ByteBPE, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, vocabulary, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, fields: str, each: Callable) -> DataFrame:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    columns = [(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary_file(vocabulary), pattern)
        for batch in batches:
            for start, texts in text_groups(strings(batch.column(1)).to_pylist()):
                made = [each(bpe, ids) for ids in bpe.encode(texts)]
                arrays = [batch.column(0).slice(start, len(texts)), *(pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(name for name, _ in columns)])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {fields}")
