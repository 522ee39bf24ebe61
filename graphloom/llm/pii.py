"""Personal data: pattern spans, and spans from a character-level bidirectional LSTM with CRF transitions.

The patterns find what has their form and nothing else: a phone number that runs on into another number is lost to them, as are phones
without a plus sign, cards with other separators, masked e-mail addresses, newer IP addresses and secrets. The network learns these from
labelled spans: a bounded sample of pieces of all texts, labelled by the patterns and by a closer look at what they swallow, and drawn
pieces with other spellings of the same kinds and with look-alikes that are none. It reads every window of every text (``tagger``).
A span of the network counts if it has the form of its kind and touches no pattern span; pattern spans always stay.

Defined results: null text counts as empty and stays null when redacted; repeated rows repeat; other columns are ignored, and kept when
redacted, whatever their names; rows with null ids are read like others; an empty table gives no rows; the network then learns from the
drawn pieces alone.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import span_hashes, strings, text_chunks, tidied
from graphloom.llm.tagger import PAD, Tagger, char_ids, tag_ids

#: Kinds with patterns, and all kinds that the network knows.
KINDS = ("email", "ip", "card", "phone")
LEARNED = (*KINDS, "secret")
#: Pieces of text (bytes) to learn from: sampled ones with a digit or an at-sign, sampled ones without, drawn ones; passes over them.
PIECE, MARKED, PLAIN, DRAWN, EPOCHS, SEED = 96, 1000, 600, 1600, 5, 11

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What the labels of sampled pieces hold beside the patterns: phones and cards that a longer match has swallowed, and named secrets.
_PHONE_WITHIN = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_CARD_WITHIN = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})")
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(](?:at|@)[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[A-Za-z0-9-]+)+")


_SECRET_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_LOOSE = re.compile(r"[0-9@]")
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
#: Bytes of text read at once.
CHUNK = 1 << 19


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each match holds one at-sign; its local part reaches as far left as its characters allow, but not into the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    """A chain of numbers joined by single dots holds a match in every four of them."""
    for chain in _CHAIN.finditer(text):
        if chain.group().count(".") < 3:
            continue
        at, parts = chain.start(), chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then kind; each kind leftmost without overlaps, failing matches dropped."""
    found = [*_emails(text), *_ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], LEARNED.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def well_formed(kind: str, piece: str) -> bool:
    """The form that a span of the network must have."""
    digits = _digits(piece)
    if kind == "email":
        return bool(_OBFUSCATED.fullmatch(piece))
    if kind == "ip":
        try:
            return piece.count(":") > 1 and ipaddress.ip_address(piece).version == 6
        except ValueError:
            return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and all(c in "0123456789 -./_" for c in piece) and piece[0].isdigit() and piece[-1].isdigit()
    if kind == "phone":
        return 9 <= len(digits) <= 15 and any(c in " ()-./" for c in piece) and all(c in "0123456789 +()-./" for c in piece) and piece[-1].isdigit() and piece[0] in "+(0123456789"
    return len(piece) >= 16 and piece.isascii() and not any(c.isspace() for c in piece) and any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece) and piece[0].isalnum() and piece[-1].isalnum() and len(set(piece)) >= 8


def all_spans(base: list[Span], added: list[Span], text: str) -> list[Span]:
    """Base spans and those of the network that touch none of them and have the form of their kind. A secret is a whole run of its characters, and no span cuts a number."""
    whole = {(k, *(_run(text, a, b) if k == "secret" else (a, b))) for k, a, b in added}
    return in_order(base + [(k, a, b) for k, a, b in whole if well_formed(k, text[a:b]) and not _within_number(text, a, b) and not any(a < d and c < b for _, c, d in base)])


def _within_number(text: str, a: int, b: int) -> bool:
    """Whether a span begins or ends amid digits."""
    return text[a - 1 : a + 1].isdecimal() and a > 0 or b < len(text) and text[b - 1 : b + 1].isdecimal()


def _run(text: str, a: int, b: int) -> tuple[int, int]:
    while a > 0 and text[a - 1] in _SECRET_CHARACTERS:
        a -= 1
    while b < len(text) and text[b] in _SECRET_CHARACTERS:
        b += 1
    return a, b


# What the network learns from


def label_spans(text: str) -> list[Span]:
    """Labels of a sampled piece: the pattern spans, and what a closer look at the same text finds."""
    found = base_spans(text)
    more = [("secret", *m.span(1)) for m in _SECRET.finditer(text)] + [("phone", *m.span()) for m in _PHONE_WITHIN.finditer(text)]
    more += [("card", *m.span()) for m in _CARD_WITHIN.finditer(text) if luhn(_digits(m.group()))] + [("email", *m.span()) for m in _OBFUSCATED.finditer(text)]
    for kind, a, b in more:
        if not any(a < d and c < b for _, c, d in found):
            found.append((kind, a, b))
    return in_order(found)


def drawn_pieces(n: int, contexts: list[str], seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Texts with one or two spans of the five kinds in several spellings, or with look-alikes that are none, amid the given contexts."""
    draw = np.random.default_rng(seed)
    number = lambda size: "".join(map(str, draw.integers(0, 10, size)))
    letters = lambda alphabet, low, high: "".join(draw.choice(list(alphabet), int(draw.integers(low, high))))
    word = lambda: letters("abcdefghijklmnopqrstuvwxyz", 2, 9)
    pick = lambda *options: options[int(draw.integers(len(options)))]

    def email() -> str:
        user, host, top = f"{word()}{pick('.', '_', '', '-')}{pick(word(), number(2))}", f"{word()}{pick('', number(1))}", pick("com", "example.com", "org", "net", "co.uk")
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", "."))
        return f"{user}{at}{host}{dot}{top.replace('.', dot)}"

    def address() -> str:
        if draw.integers(3):
            return ".".join(str(x) for x in draw.integers(0, 256, 4))
        groups = [f"{x:x}" for x in draw.integers(0, 1 << 16, 8)]
        return ":".join(groups) if draw.integers(2) else ":".join(groups[:3]) + "::" + ":".join(groups[3:5])

    def card(valid: bool = True) -> str:
        body = str(draw.integers(3, 7)) + number(int(pick(14, 14, 14, 12, 13)))
        digits = next(body + str(d) for d in draw.permutation(10).tolist() if luhn(body + str(d)) == valid)
        return pick("", "", "", " ", "-", ".").join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def phone() -> str:
        area, mid, end = number(3), number(3), number(4)
        return pick(f"+1 ({area}) {mid}-{end}", f"+1 ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+{number(2)} {area} {mid}{end}", f"1-{area}-{mid}-{end}")

    def secret() -> tuple[str, str]:
        value = pick(letters("0123456789abcdef", 32, 65), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 49), "AKIA" + letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 17), letters("0123456789ABCDEF", 32, 65))
        name = pick("token", "secret", "api_key", "password", "TOKEN", "access_key", "Token", "auth_token", "client_secret")
        return f"{name}{pick(' = ', '=', ': ')}{pick(chr(34), chr(34), chr(39), '')}", value

    def alike() -> str:
        return pick(f"{word()}={number(4)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)}", f"{word()}@{word()}", number(int(draw.integers(1, 11))), f"{number(2)}%", f"{word()}{number(3)}", card(False), card(False), f"{number(2)}:{number(2)}", f"the {word()} token of {word()}", f"{word()} at {word()} dot {word()}", f"{number(3)} {number(3)} {number(2)}")

    out = []
    for i in range(n):
        kind = [*LEARNED, ""][i % 6]
        context = pick(*contexts) if contexts else " ".join(word() for _ in range(7)) + "."
        words = context.split() or [word()]
        text = " ".join(words[: int(draw.integers(0, 6))])[-40:]
        text += " " if text else ""
        spans: list[Span] = []
        for kind in (kind, pick("email", "ip", "card", "phone", "secret", ""))[: 1 + int(draw.integers(2))]:
            lead, piece = secret() if kind == "secret" else ("", {"email": email, "ip": address, "card": card, "phone": phone, "": alike}[kind]())
            text += lead
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + (lead[-1] if lead[-1:] in (chr(34), chr(39)) else "") + pick(" ", " ", " ", ". ", ", ", "!! ", "### ", " | ")
        out.append((text + " ".join(words[-5:]), spans))
    return out


def train_tagger(sampled: list[str], drawn: int = DRAWN, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """A tagger that learned from sampled pieces, by their labels, and from drawn ones."""
    contexts = [t for text in sampled if not _LOOSE.search(text) and len(t := text.strip()) > 30]
    examples = [(text, label_spans(text)) for text in sampled] + drawn_pieces(drawn, contexts, seed)
    size = max(32, *(len(text) for text, _ in examples))
    ids, tags = np.full((len(examples), size), PAD, np.int64), np.zeros((len(examples), size), np.int64)
    for r, (text, spans) in enumerate(examples):
        ids[r, : len(text)] = char_ids(text)
        tags[r, : len(text)] = tag_ids(spans, LEARNED, 0, len(text))
    tagger = Tagger(LEARNED, seed=seed)
    tagger.train(ids, tags, epochs, seed=seed)
    return tagger


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether it holds a digit or an at-sign) of the pieces of all texts; no piece cuts a character."""
    sizes = np.diff(offsets)
    counts = -(-sizes // PIECE)
    starts = np.repeat(offsets[:-1], counts) + PIECE * (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    ends = np.minimum(starts + PIECE, np.repeat(offsets[1:], counts))
    held = np.append(data, np.uint8(0))
    for _ in range(3):  # a character has at most three more bytes after its first
        starts, ends = (x + ((held[x] & 0xC0) == 0x80) for x in (starts, ends))
    sums = np.concatenate([[0], np.cumsum(_MARK[data])])
    return starts, ends, sums[ends] > sums[starts]


def sample_pieces(docs: DataFrame, text_col: str = "text", marked: int = MARKED, plain: int = PLAIN) -> list[str]:
    """About ``marked`` distinct pieces with a digit or an at-sign and ``plain`` without, drawn by hash from the pieces of all texts.

    The shares follow from a count of all pieces, so no task sends more than its part; what arrives is cut to the bounds, by hash.
    """
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                has = _pieces(data, offsets)[2]
                n += (len(has) - has.sum(), has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in n], names=["plain", "marked"])

    there = texts.mapInArrow(tidied(count), "plain long, marked long").agg(F.sum("plain"), F.sum("marked")).first()
    wanted = (plain, marked)
    shares = [min(1.0, 1.2 * w / max(1, n or 0)) for w, n in zip(wanted, there, strict=True)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                starts, ends, has = _pieces(data, offsets)
                hashes = span_hashes(data, starts, ends, lower=False)
                on = np.flatnonzero((hashes >> np.uint64(11)) / float(1 << 53) < np.where(has, shares[1], shares[0]))
                said = [data[a:b].tobytes().decode() for a, b in zip(starts[on].tolist(), ends[on].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(has[on]), pa.array(hashes[on].view(np.int64)), pa.array(said, pa.string())], names=["has", "hash", "piece"])

    found = texts.mapInArrow(tidied(draw), "has boolean, hash long, piece string").distinct().collect()
    return [r.piece for has in (False, True) for r in sorted((r for r in found if r.has == has), key=lambda r: (r.hash, r.piece))[: wanted[has]]]


def fit(docs: DataFrame, text_col: str = "text", epochs: int = EPOCHS) -> Tagger:
    """Learn from a bounded sample of the pieces of all texts, and from drawn pieces."""
    return train_tagger(sample_pieces(docs, text_col), epochs=epochs)


# Reading


def _found(tagger: Tagger, texts: pa.Array) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """(row, text, pattern spans, all spans) of each text that is not empty."""
    for lo, hi, data, offsets in text_chunks(texts, CHUNK):
        held = texts.slice(lo, hi - lo).to_pylist()
        sums = np.concatenate([[0], np.cumsum(_MARK[data])])
        marked = sums[offsets[1:]] > sums[offsets[:-1]]  # every pattern span holds a digit or an at-sign
        for i, (text, added) in enumerate(zip(held, tagger.spans(held), strict=True)):
            base = base_spans(text) if marked[i] else []
            if text:
                yield lo + i, text, base, all_spans(base, added, text) if added else base


def find_spans(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all spans), n_added (those of the network) of every whole text."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digests, said, added = np.zeros((4, n), np.int64), [empty] * n, [""] * n, np.zeros(n, np.int64)
            for r, _, base, every in _found(tagger, strings(batch.column(1))):
                for kind, _, _ in base:
                    counts[KINDS.index(kind), r] += 1
                if base:
                    digests[r] = hashlib.sha256(joined(base).encode()).hexdigest()
                said[r], added[r] = joined(every), len(every) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(said, pa.string()), pa.array(added)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tidied(run), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the earliest, then longest, is replaced."""
    at = docs.columns.index(text_col)

    def replaced(text: str, spans: list[Span]) -> str:
        parts, end = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= end:
                parts += [text[end:a], f"<{kind}>"]
                end = b
            elif b > end:
                end = b
        return "".join([*parts, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for r, text, _, every in _found(tagger, strings(batch.column(at))):
                if every:
                    texts[r] = replaced(text, every)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidied(run), docs.schema)
