"""Token counts under a unigram language model, by dynamic programming over a trie of pre-tokens.

Each distinct pre-token is inserted in a trie; a node stands for a prefix, and its forward score (the best sum of piece scores that
spells the prefix) and its number of pieces are computed once, when the node is made, from its ancestors. Pre-tokens that share a
prefix share that work, and a pre-token's count is read at its terminal node.

The pieces come from a public piece vocabulary in its order of rank; a piece of rank r gets the log-probability of Zipf's law,
-log(r) - log(H), as the file holds merge ranks and no probabilities. A character that no piece covers costs as many pieces as it has
UTF-8 bytes, each at the byte score. Of segmentations with equal scores the one with fewer pieces counts.

Pre-tokens are maximal runs without ASCII white space, each with the word mark in front. Defined results: null and empty texts have
no tokens; repeated rows repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.byte_bpe import vocabulary_file
from graphloom.llm.common import strings, text_chunks

#: The word mark of piece vocabularies (fixed value).
MARK = "▁"
#: Nodes and terminal counts held by one worker; beyond that the trie is begun anew, which changes no count.
MOST_NODES, MOST_WORDS = 1_000_000, 500_000


def read_pieces(path: str) -> dict[str, float]:
    """Log-probability by piece, without control and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    harmonic = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {model.id_to_piece(i): -math.log(r) - harmonic for r, i in enumerate(pieces, 1)}


class PieceTrie:
    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        self.byte_score = min(pieces.values()) - 10.0
        # Which lengths occur by last character: the others need not be tried.
        self.sizes: dict[str, list[int]] = {}
        for piece in pieces:
            self.sizes.setdefault(piece[-1], []).append(len(piece))
        self.sizes = {c: sorted(set(sizes)) for c, sizes in self.sizes.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The number of pieces of ``word``."""
        child, best, count, pieces = self.child, self.best, self.count, self.pieces
        path = [0]
        node = 0
        for depth, letter in enumerate(word, 1):
            after = child.get((node, letter))
            if after is None:
                after = child[node, letter] = len(best)
                n = len(letter.encode("utf-8", "surrogatepass"))
                top, least = best[node] + n * self.byte_score, count[node] + n
                for size in self.sizes.get(letter, ()):
                    if size > depth:
                        break
                    score = pieces.get(word[depth - size : depth])
                    if score is not None:
                        before = path[depth - size]
                        score += best[before]
                        if score > top or score == top and count[before] + 1 < least:
                            top, least = score, count[before] + 1
                best.append(top)
                count.append(least)
            node = after
            path.append(node)
        return count[node]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(read_pieces(vocabulary_file(vocabulary)))
        known: dict[bytes, int] = {}
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(strings(batch.column(1))):
                whole, bounds = data.tobytes(), offsets.tolist()
                split = [whole[a:b].split() for a, b in zip(bounds, bounds[1:])]
                wanted = set().union(*split)
                missing = wanted - known.keys()
                if len(known) + len(missing) > MOST_WORDS:
                    known.clear()
                    missing = wanted
                for word in sorted(missing):
                    if len(trie.best) > MOST_NODES:
                        trie.clear()
                    known[word] = trie.insert(MARK + word.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.array([len(s) for s in split], np.int64)),
                        pa.array(np.array([sum(map(known.__getitem__, s)) for s in split], np.int64)),
                    ],
                    names=["doc_id", "n_pretokens", "n_tokens"],
                )

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
