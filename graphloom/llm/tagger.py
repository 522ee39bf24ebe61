"""A character-level bidirectional LSTM with CRF transitions, written and trained in numpy.

Training runs in double precision on windows of text. Reading runs in single precision over every window of a text: windows overlap, the
emissions of the windows over a position are averaged with weights that fall towards a window's edges, and the tags of the whole text
are the best path through these averages.

Most positions need no search. A position is ``frozen`` if every best path is outside there, which follows where outside leads the
other tags by so much, over a few positions from there on, that setting these to outside, and an inside tag after them to begin, gains
more than transitions and that begin tag can cost. The text is decoded between frozen positions, which gives the tags of the best path
through the whole of it. Training leaves all transitions open, so that outside leads inside too where no span is; reading bars inside
tags that follow neither begin nor inside of their kind.
"""

from __future__ import annotations

import numpy as np

#: Window and stride in characters, hidden units each way, and the bound on learned transitions.
WINDOW, STRIDE, HIDDEN, MOST_TRANSITION = 192, 168, 10, 0.5
#: Windows read at once, characters of a text read at once, and positions that are looked at to see whether the first is frozen.
BATCH, SLAB, AHEAD = 1024, 1 << 17, 5
BARRED = -1e4
#: ASCII characters are their own ids; letters and other characters beyond them are one id each, and what lies outside a text is one.
LETTER, OTHER, PAD, ALPHABET = 128, 129, 130, 131


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = points.astype(np.uint8, casting="unsafe")
    beyond = points > 127
    if beyond.any():
        found, place = np.unique(points[beyond], return_inverse=True)
        ids[beyond] = np.array([LETTER if chr(p).isalpha() else OTHER for p in found.tolist()], np.uint8)[place]
    return ids


def tag_ids(spans: list[tuple[str, int, int]], kinds: tuple[str, ...], start: int, size: int) -> np.ndarray:
    """Tags of the characters from ``start``; of overlapping spans the earlier one counts."""
    tags = np.zeros(size, np.int64)
    for kind, a, b in spans:
        lo, hi = max(a - start, 0), min(b - start, size)
        if lo < hi and not tags[lo:hi].any():
            tags[lo:hi] = 2 + 2 * kinds.index(kind)
            if a >= start:
                tags[lo] -= 1
    return tags


def spans_of(tags: np.ndarray, kinds: tuple[str, ...], start: int = 0) -> list[tuple[str, int, int]]:
    out, open_at, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if open_at >= 0 and t != 2 + 2 * kind:
            out.append((kinds[kind], start + open_at, start + i))
            open_at = -1
        if t % 2:
            open_at, kind = i, (t - 1) // 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Bidirectional LSTM over characters, linear emissions, CRF transitions. Tags: outside, then begin and inside of each kind."""

    def __init__(self, kinds: tuple[str, ...], hidden: int = HIDDEN, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 1 + 2 * len(kinds)
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["x" + side] = draw.normal(0, 0.2, (ALPHABET, 4 * hidden))
            self.p["h" + side] = draw.normal(0, 0.2, (hidden, 4 * hidden))
            # Gates: in, forget, out, new; a memory is kept at first.
            self.p["c" + side] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p["o"] = draw.normal(0, 0.2, (2 * hidden, self.tags))
        self.p["ob"] = np.zeros(self.tags)
        self.p["t"] = np.zeros((self.tags, self.tags))
        self.p["s"] = np.zeros(self.tags)
        # Inside follows only begin or inside of its own kind, and never starts a text.
        self.barred = np.zeros((self.tags, self.tags))
        self.barred[:, 2::2] = BARRED
        for k in range(2, self.tags, 2):
            self.barred[[k - 1, k], k] = 0
        self.barred_start = np.zeros(self.tags)
        self.barred_start[2::2] = BARRED

    # Training

    def _one_way(self, ids: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        n, size = ids.shape
        h = self.hidden
        x, w, b = self.p["x" + side], self.p["h" + side], self.p["c" + side]
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        out, kept = np.zeros((n, size, h)), []
        for t in range(size) if side == "f" else range(size - 1, -1, -1):
            gates = x[ids[:, t]] + state @ w + b
            i, f, o = _sigmoid(gates[:, :h]), _sigmoid(gates[:, h : 2 * h]), _sigmoid(gates[:, 2 * h : 3 * h])
            g = np.tanh(gates[:, 3 * h :])
            old_state, old_cell = state, cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            kept.append((t, i, f, o, g, old_state, old_cell, squashed))
        return out, kept

    def _gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, size = ids.shape
        k = self.tags
        ways = {s: self._one_way(ids, s) for s in "fb"}
        both = np.concatenate([ways["f"][0], ways["b"][0]], 2)
        e = both @ self.p["o"] + self.p["ob"]
        trans, start = self.p["t"], self.p["s"]
        alpha, beta = np.zeros((n, size, k)), np.zeros((n, size, k))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, size):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(size - 2, -1, -1):
            beta[:, t] = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        every, steps = np.arange(n)[:, None], np.arange(size)[None, :]
        gold = e[every, steps, tags].sum(1) + start[tags[:, 0]] + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        d_e = np.exp(alpha + beta - total[:, None, None])
        grad = {"s": d_e[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=k), "t": np.zeros((k, k))}
        for t in range(1, size):
            pair = alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            grad["t"] += np.exp(pair).sum(0)
        np.add.at(grad["t"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        d_e[every, steps, tags] -= 1
        grad["o"], grad["ob"] = np.tensordot(both, d_e, ((0, 1), (0, 1))), d_e.sum((0, 1))
        d_both = d_e @ self.p["o"].T
        h = self.hidden
        for s, d_out in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            w = self.p["h" + s]
            d_x, d_w, d_c = np.zeros_like(self.p["x" + s]), np.zeros_like(w), np.zeros(4 * h)
            d_state, d_cell = np.zeros((n, h)), np.zeros((n, h))
            for t, i, f, o, g, old_state, old_cell, squashed in reversed(ways[s][1]):
                d = d_state + d_out[:, t]
                d_cell = d_cell + d * o * (1 - squashed**2)
                d_gates = np.concatenate([d_cell * g * i * (1 - i), d_cell * old_cell * f * (1 - f), d * squashed * o * (1 - o), d_cell * i * (1 - g**2)], 1)
                d_cell = d_cell * f
                d_w += old_state.T @ d_gates
                d_c += d_gates.sum(0)
                np.add.at(d_x, ids[:, t], d_gates)
                d_state = d_gates @ w.T
            grad["x" + s], grad["h" + s], grad["c" + s] = d_x, d_w, d_c
        return float((total - gold).mean()), {name: v / n for name, v in grad.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam on the CRF's negative log-likelihood; the mean loss of each pass.

        Batches hold windows of similar length and are cut where their longest ends, one padded position left to learn from.
        """
        draw = np.random.default_rng(seed)
        lengths = np.minimum(ids.shape[1], (ids != PAD).sum(1) + 1)
        first, second, step, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, []
        for epoch in range(epochs):
            order, seen = draw.permutation(len(ids)), []
            order = order[np.argsort(lengths[order] // 16, kind="stable")]
            for at in draw.permutation(np.arange(0, len(ids), batch)).tolist():
                pick = order[at : at + batch]
                size = int(lengths[pick].max())
                loss, grad = self._gradients(ids[pick, :size], tags[pick, :size])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
                pace = rate * (1 - 0.8 * epoch / max(1, epochs - 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-12))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - pace * first[k] / (np.sqrt(second[k]) + 1e-8)
                for k in "ts":
                    self.p[k] = np.clip(self.p[k], -MOST_TRANSITION, MOST_TRANSITION)
            losses.append(float(np.mean(seen)))
        return losses

    # Reading

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Emissions of windows (rows of ids) as (position, window, tag), in single precision."""
        n, size = ids.shape
        h = self.hidden
        # A sigmoid is half a tanh, so one tanh serves all four gates; each gate's numbers lie together.
        scale = np.array([0.5, 0.5, 0.5, 1.0])[:, None, None]
        by_gate = lambda x: (x.reshape(len(x), 4, h).transpose(1, 0, 2) * scale).astype(np.float32)
        at = np.ascontiguousarray(ids.T).astype(np.intp)
        out = np.zeros((size, n, self.tags), np.float32)
        gates, more, held = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32), np.empty((size, n, h), np.float32)
        for side, rows in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            x, w = by_gate(self.p["x" + side] + self.p["c" + side]), by_gate(self.p["h" + side])
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(size) if side == "f" else range(size - 1, -1, -1):
                for g in range(4):
                    np.take(x[g], at[t], axis=0, out=gates[g], mode="clip")
                gates += np.matmul(state, w, out=more)
                np.tanh(gates, out=gates)
                soft = gates[:3]
                soft *= 0.5
                soft += 0.5
                cell *= gates[1]
                cell += gates[0] * gates[3]
                state = np.multiply(gates[2], np.tanh(cell), out=held[t])
            out += (held.reshape(size * n, h) @ self.p["o"][rows].astype(np.float32)).reshape(out.shape)
        out += self.p["ob"].astype(np.float32)
        return out

    def averaged(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """The averaged emissions (position, tag) of each of several pieces of text, given as ids; windows stand at multiples of the stride."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        windows = np.maximum(0, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)) + ((sizes > 0) & (sizes <= WINDOW - STRIDE))
        begins = np.cumsum(sizes + WINDOW) - sizes - WINDOW
        flat = np.full(int((sizes + WINDOW).sum()), PAD, np.uint8)
        for begin, piece in zip(begins.tolist(), pieces, strict=True):
            flat[begin : begin + len(piece)] = piece
        starts = np.repeat(begins, windows) + STRIDE * (np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows))
        sums = np.zeros((len(flat) + WINDOW, self.tags), np.float32)
        weights = np.zeros(len(flat) + WINDOW, np.float32)
        for lo in range(0, len(starts), BATCH):
            part = starts[lo : lo + BATCH]
            e = self.emissions(flat[part[:, None] + np.arange(WINDOW)])
            # Windows that share no position are added at once: every other one, as a window is shorter than two strides.
            for odd in (0, 1):
                some = part[odd::2]
                places = (some[:, None] + np.arange(WINDOW)).ravel()
                sums[places] += (e[:, odd::2] * _MIDDLE[:, None, None]).transpose(1, 0, 2).reshape(len(places), self.tags)
                weights[places] += np.tile(_MIDDLE, len(some))
        return [sums[a : a + n] / weights[a : a + n, None] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]

    def frozen(self, e: np.ndarray) -> np.ndarray:
        """Positions that are outside on every best path, given the emissions of a text to its end or ``AHEAD`` positions beyond.

        Let the n positions from one on lead by more than four transitions each. A span that covers the first and ends among them loses
        against outside there, as at most n + 1 transitions change. One that goes on after them loses against outside and a begin tag
        after them if the leads, less n + 2 changed transitions, exceed what inside has over begin there.
        """
        n, change = len(e), 2 * MOST_TRANSITION
        lead, over = np.full(n + AHEAD, -np.inf, np.float32), np.zeros(n + AHEAD, np.float32)
        best = e[:, 1].copy()
        for tag in range(1, self.tags, 2):
            np.maximum(over[:n], e[:, tag + 1] - e[:, tag], out=over[:n])
            np.maximum(best, e[:, tag], out=best)
            np.maximum(best, e[:, tag + 1], out=best)
        lead[:n] = e[:, 0] - best
        out, sums, cold = np.zeros(n, bool), np.zeros(n, np.float32), np.ones(n, bool)
        for ahead in range(1, AHEAD):
            cold &= lead[ahead - 1 : ahead - 1 + n] > 2 * change
            sums += lead[ahead - 1 : ahead - 1 + n] - change
            out |= cold & (sums > over[ahead : ahead + n] + 2 * change + 1e-3)
        return out

    def decode(self, e: np.ndarray, first: bool = True, last: bool = True) -> np.ndarray:
        """The best tags for emissions between outside positions, or from a text's first or to its last character."""
        e = e.astype(np.float64)
        trans = self.p["t"] + self.barred
        score = (self.p["s"] + self.barred_start if first else trans[0]) + e[0]
        back = np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            way = score[:, None] + trans
            back[t] = way.argmax(0)
            score = way[back[t], np.arange(self.tags)] + e[t]
        tags = np.zeros(len(e), np.int64)
        tags[-1] = (score if last else score + trans[:, 0]).argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The network's spans in each whole text."""
        out: list[list[tuple[str, int, int]]] = []
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            ids = char_ids(text)
            if len(ids) > SLAB:
                out += self._read(held) + [self._read_long(ids)]
                held, size = [], 0
                continue
            held.append(ids)
            size += len(ids)
            if size >= SLAB:
                out += self._read(held)
                held, size = [], 0
        return out + self._read(held)

    def _read(self, pieces: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        return [self._between(self._open(e, len(e)), len(e)) for e in self.averaged(pieces)] if pieces else []

    def _read_long(self, ids: np.ndarray) -> list[tuple[str, int, int]]:
        """Slab by slab: a slab begins at a multiple of the stride and is read with a window before it and one after it."""
        size = SLAB // STRIDE * STRIDE
        margin = -(-WINDOW // STRIDE) * STRIDE
        parts = []
        for begin in range(0, len(ids), size):
            lead = min(begin, margin)
            e = self.averaged([ids[begin - lead : begin + size + margin]])[0]
            own = e[lead : lead + size + AHEAD]
            parts += [(begin + a, x) for a, x in self._open(own, min(size, len(own)))]
        return self._between(parts, len(ids))

    def _open(self, e: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
        """Stretches of the first ``size`` positions that are not frozen."""
        fixed = np.ones(size + 2, bool)
        fixed[1:-1] = self.frozen(e)[:size]
        edges = np.flatnonzero(fixed[1:] != fixed[:-1])
        return [(a, e[a:b].copy()) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]

    def _between(self, parts: list[tuple[int, np.ndarray]], n: int) -> list[tuple[str, int, int]]:
        """Decode the stretches (start, emissions) of a text of ``n`` characters; those that touch are one."""
        joined: list[tuple[int, list[np.ndarray]]] = []
        for at, e in parts:
            if joined and joined[-1][0] + sum(map(len, joined[-1][1])) == at:
                joined[-1][1].append(e)
            else:
                joined.append((at, [e]))
        out: list[tuple[str, int, int]] = []
        for at, es in joined:
            e = np.concatenate(es)
            out += spans_of(self.decode(e, at == 0, at + len(e) == n), self.kinds, at)
        return out


_MIDDLE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
