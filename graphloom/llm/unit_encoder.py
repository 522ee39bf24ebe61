"""Token ids of whole chunks of texts by a byte-level rank file, with a bounded memory of what was encoded before."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import tiktoken

from graphloom.llm.byte_bpe import read_ranks
from graphloom.llm.common import runs, span_hashes

#: Logarithm of the number of slots of the table of units, and the bytes of units after which an encoder starts afresh.
SLOT_BITS, CACHE_BYTES = 18, 2 << 20
#: Whether the byte after a space makes that space a border for certain: no ASCII white space or control, no lead byte of other white space.
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def added_tokens(path: str) -> dict[bytes, int]:
    """The ids of the added tokens of the JSON file beside a rank file, if there is one."""
    beside = Path(path).with_suffix(".json")
    tokens = json.loads(beside.read_text(encoding="utf-8"))["added_tokens"] if beside.exists() else []
    if any(token[rule] for token in tokens for rule in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{beside} has added tokens that are not matched as they stand")
    return {token["content"].encode(): token["id"] for token in tokens}


class Pool:
    """One array to which others are appended."""

    def __init__(self, kind: type):
        self.n, self.held = 0, np.zeros(1024, kind)

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.held):
            self.held = np.concatenate([self.held[:at], np.zeros(max(self.n, len(self.held) * 3 // 2) - at, self.held.dtype)])
        self.held[at : self.n] = values
        return at


class UnitEncoder:
    """Ids by a rank file; what stands between certain borders of the byte-level pattern is encoded once and remembered.

    A unit begins at a space before which the pattern always parts. The units of a chunk are looked up by hash in a direct-mapped table,
    and their bytes are compared with those remembered, so a collision changes nothing. New units are encoded in one call, one after the
    other, which is a text that parts at each of them.

    The rank file holds the vocabulary of the JSON file of the same name, and its ids are those that the JSON file gives. Texts are first
    cut at the added tokens of that file, which have ids of their own. ``end`` is an id that follows each text.
    """

    def __init__(self, path: str, pattern: str, end: int | None = None):
        self.added = added_tokens(path)
        self.end = end
        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.ids, self.raw = Pool(np.uint32), Pool(np.uint8)
        # Of each unit: where its ids begin, how many they are, where its bytes begin and how many they are.
        self.columns = [Pool(np.int32) for _ in range(4)]
        own = np.array([self.end or 0, *self.added.values()], np.uint32)  # unit 0 is the end, the added tokens follow
        self._add(own, np.ones(len(own), np.int64), np.zeros(0, np.uint8), np.zeros(len(own), np.int64))

    def _add(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of these units."""
        first = self.columns[0].n
        at_ids, at_raw = self.ids.add(ids), self.raw.add(raw)
        for pool, values in zip(self.columns, (at_ids + np.cumsum(counts) - counts, counts, at_raw + np.cumsum(sizes) - sizes, sizes), strict=True):
            pool.add(values)
        return first

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode new units; their numbers."""
        sizes = ends - starts
        usual = (sizes > 1) & (data[starts] == 32) & _PLAIN[data[np.minimum(starts + 1, len(data) - 1)]]
        numbers = np.zeros(len(starts), np.int64)
        at = np.flatnonzero(usual)
        if len(at):
            raw = data[runs(starts[at], sizes[at])]
            ids = np.array(self.coder.encode_ordinary(raw.tobytes().decode()), np.uint32)
            reached, stops = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes[at])
            last = np.searchsorted(reached, stops) + 1
            if last[-1] > len(ids) or not np.array_equal(reached[last - 1], stops):
                raise RuntimeError("the pattern does not part before a space that other characters follow")
            numbers[at] = self._add(ids, np.diff(last, prepend=0), raw, sizes[at]) + np.arange(len(at))
        at = np.flatnonzero(~usual)
        if len(at):
            parts = [self.coder.encode_ordinary(data[a:b].tobytes().decode()) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            ids = np.array([i for part in parts for i in part], np.uint32)
            numbers[at] = self._add(ids, np.array([len(p) for p in parts], np.int64), data[runs(starts[at], sizes[at])], sizes[at]) + np.arange(len(at))
        return numbers

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(borders of texts and added tokens, unit of each segment that is an added token or -1)."""
        text, found = data.tobytes() if self.added else b"", []
        for unit, mark in enumerate(self.added, 1):
            at = text.find(mark)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark) - 1, "right"):
                    found.append((at, at + len(mark), unit))
                    at = text.find(mark, at + len(mark))
                else:  # it runs over the end of a text
                    at = text.find(mark, at + 1)
        borders = np.unique(np.concatenate([offsets, np.array([x for a, b, _ in found for x in (a, b)], np.int64)]))
        special = np.full(len(borders), -1, np.int64)
        special[np.searchsorted(borders, [a for a, _, _ in found])] = [u for _, _, u in found]
        return borders, special

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end) of texts that lie one after the other in ``data``."""
        if self.raw.n > CACHE_BYTES:
            self.clear()
        n = len(offsets) - 1
        borders, special = self._segments(data, offsets)
        inner = borders[(borders > 0) & (borders < len(data))]
        opens = np.zeros(len(data), bool)
        if len(data):
            opens[:-1] = (data[:-1] == 32) & _PLAIN[data[1:]]
            opens[inner - 1] = False
            opens[inner] = opens[0] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        segment = np.searchsorted(borders, starts, "right") - 1
        marked = special[segment] >= 0
        if marked.any():
            on = ~marked | (starts == borders[segment])
            starts, ends, segment, marked = starts[on], ends[on], segment[on], marked[on]
        units = np.where(marked, special[segment], -1)
        ask = np.flatnonzero(~marked)
        units[ask] = self._look_up(data, starts[ask], ends[ask])
        places = np.searchsorted(starts, offsets[1:])
        if self.end is not None:
            units = np.insert(units, places, 0)
            places = places + np.arange(1, n + 1)
        counts = self.columns[1].held[units]
        reached = np.concatenate([[0], np.cumsum(counts)])
        return self.ids.held[runs(self.columns[0].held[units], counts)], reached[places]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends, lower=False)
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        units = np.where(self.keys[slots] == hashes, self.places[slots], -1).astype(np.int64)
        new = np.flatnonzero(units < 0)
        if len(new):
            _, first, place = np.unique(hashes[new], return_index=True, return_inverse=True)
            numbers = self._learn(data, starts[new[first]], ends[new[first]])
            units[new] = numbers[place]
            self.keys[slots[new[first]]], self.places[slots[new[first]]] = hashes[new[first]], numbers
        # Hashes only propose: every unit's bytes are those remembered, or it is encoded by itself.
        sizes, held = ends - starts, self.columns[3].held[units]
        wrong = sizes != held
        same = np.flatnonzero(~wrong)
        differ = data[runs(starts[same], sizes[same])] != self.raw.held[runs(self.columns[2].held[units[same]], sizes[same])]
        if differ.any():
            wrong[same[np.unique(np.searchsorted(np.cumsum(sizes[same]), np.flatnonzero(differ), "right"))]] = True
        if wrong.any():
            units[wrong] = self._learn(data, starts[wrong], ends[wrong])
        return units
