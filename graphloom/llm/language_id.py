"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams (one to three letters, with word borders) in the training texts. A
document's own list is compared with each profile by the out-of-place distance: the sum over the document's n-grams of how far their
ranks differ, the profile's length where the profile lacks one. The nearest profile names the language.

Counts cover every training text whole. What reaches the driver is one profile of fixed length for each language.

Defined results: texts that are null or have no letter are ``und`` with score 0, as are all where nothing could be learned; ties go
to the language name that sorts first; training rows with null text or language are left out; null ids count as not held out; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.byte_bpe import text_groups
from graphloom.llm.common import strings

#: N-grams in a profile and in a document's own list.
PROFILE = 400
_SALTS = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every n-gram of one to three letters, rows ascending; a word border counts as a letter of pairs and triples."""
    lowered = [" " + text.lower() for text in texts]
    points = np.frombuffer("".join([*lowered, " "]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(lowered) + 1), [*map(len, lowered), 1])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters stays, as the border
    keep[np.flatnonzero(np.diff(rows)) + 1] = True
    keep[0] = True
    letter, x, rows = letter[keep], np.where(letter, points + 2, 1)[keep], rows[keep]
    # A border may still follow a border where a text ends in one; such pairs say nothing.
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    code = np.concatenate([x[one] << 42, (x[two] << 42) | (x[two + 1] << 21), (x[three] << 42) | (x[three + 1] << 21) | x[three + 2]])
    row = np.concatenate([rows[one], rows[two], rows[three]])
    order = np.argsort(row, kind="stable")
    return code[order], row[order]


def top_codes(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank; ties go to the smaller code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(train: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = PROFILE) -> dict[str, list[int]]:
    """The ranked codes of each language; ``train`` holds text and language only of the rows to learn from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for start, texts in text_groups(strings(batch.column(1)).to_pylist()):
                codes, rows = ngram_codes(texts)
                own = langs[start : start + len(texts)]
                for lang in sorted(set(own)):
                    found, counts = np.unique(codes[(own == lang)[rows]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], names=["lang", "code", "n"])

    rows = train.select(train[lang_col].alias("lang"), train[text_col].alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("code")]
    # Two rounds, so that no task has to rank all n-grams of a language.
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(_SALTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= most)
    best: dict[str, list[tuple[int, int]]] = {}
    for lang, code, n in first.select("lang", "code", "n").collect():
        best.setdefault(lang, []).append((-n, code))
    return {lang: [code for _, code in sorted(best[lang])[:most]] for lang in sorted(best)}


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.codes = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        """(language, 1 - distance / greatest possible distance) for one document's n-grams."""
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = top_codes(codes, self.most)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.most * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, most)
        for batch in batches:
            for start, texts in text_groups(strings(batch.column(1)).to_pylist()):
                codes, rows = ngram_codes(texts)
                bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
                said = [model.predict(codes[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
