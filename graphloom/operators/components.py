"""Connected components of an edge table by contraction.

Nodes are 64-bit numbers. In a round every node joins the least of itself and its neighbours, edges are renumbered and those within one
node fall away; numbers are drawn anew for the next round, so an expected quarter of the nodes goes at least, whatever the graph's shape,
and a frequent node is gone after few rounds instead of collecting all others. Nothing is collected but one row of totals a round.

``connected_components`` names a component by its least node, for nodes that are numbers of their own (near-duplicate links). Up to
``FEW_EDGES`` edges take no round at all: a round is several shuffles, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, forget, ship, spread, stored


def numbered(edges: DataFrame, left: str, right: str, group: list[str] = ()) -> tuple[DataFrame, DataFrame, Callable[[str], F.Column]]:
    """((u, v), (id, g)): the distinct edges between numbered nodes, loops included, and each node's number with that of its group.

    Numbers are hashes; a check hash tells whether two nodes share one, and then others are drawn. The third result numbers a column.
    Edges with a null end are left out.
    """
    rows = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    spread(rows)
    for seed in range(8):
        number = lambda c, seed=seed: F.xxhash64(F.lit(seed), *group, c)
        check = lambda c, seed=seed: F.hash(F.lit(seed), *group, c)
        links = stored(rows.select(number(left).alias("u"), number(right).alias("v"), check(left).alias("cu"), check(right).alias("cv"), group_number(group).alias("g")).distinct(), "links")
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("cu").alias("c"), "g"), F.struct(F.col("v").alias("id"), F.col("cv").alias("c"), "g"))).alias("n")).select("n.*")
        nodes = stored(ends.groupBy("id").agg(F.min("g").alias("g"), F.min("c").alias("low"), F.max("c").alias("high")), "nodes")
        if nodes.where("low <> high").isEmpty():
            return links.select("u", "v"), nodes.select("id", "g"), number
        forget(links)
        forget(nodes)
    raise RuntimeError("nodes keep sharing numbers")


def group_number(group: list[str]) -> F.Column:
    return F.xxhash64(F.lit(0), *group)


def roots(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of every node with an edge to another, from the edges (u, v) of numbered nodes."""
    pairs, maps, last = links.where("u <> v"), [], None
    ship(links.sparkSession)
    for r in range(most_rounds):
        left = pairs.count()
        if left <= FEW_EDGES:
            if left:
                last = stored(pairs.coalesce(1).mapInArrow(_united, "u long, m long"), "step")
            break
        # The numbers of a round are a one-to-one function of those before, so the least of them is drawn anew.
        near = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        step = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.xxhash64(F.lit(r), F.least("u", "m")).alias("m")), "step")
        moved = pairs.join(step.select("u", F.col("m").alias("a")), "u").join(step.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
        now = stored(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs")
        if maps:
            forget(pairs)  # the edges of a round before; those of the first are the caller's
        pairs = now
        maps.append(step)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # A node that no longer has edges is settled, but keeps drawing: its number goes through the draws of all later rounds.
    found, draws = (last if last is not None else links.limit(0).select("u", F.col("v").alias("m"))), len(maps)
    for r in reversed(range(draws)):
        redrawn = F.col("s.m")
        for q in range(r + 1, draws):
            redrawn = F.xxhash64(F.lit(q), redrawn)
        found = maps[r].alias("s").join(found.alias("l"), F.col("s.m") == F.col("l.u"), "left").select(F.col("s.u").alias("u"), F.coalesce("l.m", redrawn).alias("m"))
    return found.select(F.col("u").alias("id"), F.col("m").alias("root"))


#: So many edges one task unites at once (some 100 bytes each), as rounds cost more than they save.
FEW_EDGES = 500_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges with the least of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["u", "m"])


def nodes_of(edges: DataFrame, left: str, right: str, group: list[str] = ()) -> DataFrame:
    """(*group, node) of every edge with both ends, once each."""
    rows = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return rows.select(*group, F.explode(F.array(left, right)).alias("node")).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its least node. Loops and null ends count for nothing."""
    pairs = edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
    pairs = cut(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct())
    if pairs.count() <= FEW_EDGES:
        ship(pairs.sparkSession)
        return stored(pairs.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    # Roots are numbers drawn in the rounds.
    found = cut(roots(pairs, most_rounds))
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return found.join(least, "root").select(F.col("id").alias("node"), "component")
