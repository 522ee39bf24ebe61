"""Exact top-k search by inner product with MaxScore over sharded inverted lists.

A component of a query is a term. Its impact on a vector is the product, less the least product that occurs in the shard, so impacts are
never negative and each term has an upper bound; the posting list of a term holds the vectors with an impact above 0. A list with more
than half of the shard's vectors, as in dense data, is kept as a column, which names its members by a value that is not the least.

The k-th score of some promising vectors is a first threshold. Terms are sorted by bound; the last ones, whose bounds together stay below
the threshold, are non-essential. The lists of the others are traversed. A vector in none of them is never scored; the rest are probed
for the non-essential terms, largest bound first, only while they can still compete, and the threshold rises with the scores. Shards
return their own best and are merged.

Candidates and queries are dealt in blocks of bounded size, each pair of blocks to one task: a copy of a candidate serves ``QUERY_ROWS``
queries, so what is moved stays a small part of the work, which is queries times candidates. All arithmetic is on integers.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with 0;
ties go to the smaller id; a query never finds rows of its own id; repeated candidate rows are found as often as they occur, repeated
query rows once; columns other than id and vector are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 16_384, 8_192
#: Vectors scored in full for the first threshold, as a multiple of k, and the lists that choose them.
_PROBE, _FIRST = 4, 8


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array(column.value_lengths())
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.array(column.flatten())
    return out


class Shard:
    """Inverted lists of one block of vectors, two for each component: one for queries with a positive weight there, one for negative."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.values.min(1), self.values.max(1)
        #: (members, distance from the value of least impact) of the short lists.
        self.short: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for term, column in enumerate(self.values):
            for up, least in ((True, self.low[term]), (False, self.high[term])):
                members = np.flatnonzero(column != least)
                if 2 * len(members) <= len(column):
                    self.short[term, up] = members, np.abs(column[members] - least)

    def traverse(self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Add the impacts of these terms' lists."""
        columns = np.array([(t, w > 0) not in self.short for t, w in zip(terms.tolist(), weights.tolist(), strict=True)], bool)
        for term, weight in zip(terms[~columns].tolist(), weights[~columns].tolist(), strict=True):
            members, distance = self.short[term, weight > 0]
            sums[members] += abs(weight) * distance
        if columns.any():
            at, weight = terms[columns], weights[columns]
            sums += weight @ self.values[at] - (weight * np.where(weight > 0, self.low[at], self.high[at])).sum()

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the shard's k best, best first."""
        terms = np.flatnonzero(query)
        weight = query[terms]
        least = np.where(weight > 0, self.low[terms], self.high[terms])
        bound = np.abs(weight) * (self.high[terms] - self.low[terms])
        order = np.argsort(-bound, kind="stable")
        terms, weight, least, bound = terms[order], weight[order], least[order], bound[order]
        # What the terms from position i on can add at most.
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])
        other = self.ids != query_id
        n = int(other.sum())
        base = int((weight * least).sum())
        if n <= k or not rest[0]:
            alive = np.flatnonzero(other)
        else:
            sums, done = np.zeros(len(self.ids), np.int64), min(_FIRST, len(terms))
            self.traverse(sums, terms[:done], weight[:done])
            promising = np.argpartition(-np.where(other, sums, -1), min(n, _PROBE * k) - 1)[: min(n, _PROBE * k)]
            threshold = int(np.partition(weight @ self.values[np.ix_(terms, promising)] - base, -k)[-k])
            essential = int(np.searchsorted(-rest, -threshold, "right"))  # the first position from which all others stay below
            if essential > done:
                self.traverse(sums, terms[done:essential], weight[done:essential])
                done = essential
            # Only members of an essential list have a sum above 0, or nothing is essential and all may compete.
            alive = np.flatnonzero(other & (sums + rest[done] >= threshold))
            sums = sums[alive]
            while done < len(terms) and len(alive) > k:
                step = min(len(terms), done + 4)
                sums = sums + weight[done:step] @ self.values[np.ix_(terms[done:step], alive)] - int((weight[done:step] * least[done:step]).sum())
                done = step
                threshold = max(threshold, int(np.partition(sums, -k)[-k]))
                on = sums + rest[done] >= threshold
                alive, sums = alive[on], sums[on]
        scores = weight @ self.values[np.ix_(terms, alive)] if len(terms) else np.zeros(len(alive), np.int64)
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; vectors are arrays of bigint."""
    candidates = candidates.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    queries = queries.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    key = F.xxhash64("vec_id")
    left = candidates.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if mine.num_rows and asked.num_rows:
            vectors, wanted = _matrix(mine.column("v")), _matrix(asked.column("v"))
            width = max(vectors.shape[1], wanted.shape[1])
            vectors, wanted = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, wanted))
            shard = Shard(np.array(mine.column("vec_id")), vectors)
            for query_id, query in zip(np.array(asked.column("vec_id")).tolist(), wanted, strict=True):
                found.append((query_id, *shard.top(query_id, query, k)))
        columns = [np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]), *(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (1, 2))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
