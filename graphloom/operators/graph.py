"""Knowledge-graph reads: hops, statistics, paths, reification and alias merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import group_number, nodes_of, numbered, roots
from graphloom.session import cut, spread, stored

FACT = ["subject", "relation", "object"]
LABEL_WIDTH = 72


def scoped(edges: DataFrame, sample_id: str | None) -> DataFrame:
    """The edges of one sample; None reads all."""
    return edges if sample_id is None else edges.where(F.col("sample_id") == sample_id)


def one_hop(edges: DataFrame, entities: DataFrame, name: str = "name", sample_id: str | None = None, filtered: DataFrame | None = None) -> DataFrame:
    """Facts that touch any of the entities as subject or object (with ``filtered`` those rejected by the ontology too), once each."""
    rows = edges if filtered is None else edges.unionByName(filtered, allowMissingColumns=True)
    names = entities.select(F.col(name).alias("_n")).where("_n IS NOT NULL").distinct()
    rows = scoped(rows, sample_id)
    hit = rows.join(names.withColumnRenamed("_n", "subject"), "subject", "left_semi").select(*rows.columns)
    other = rows.join(names.withColumnRenamed("_n", "object"), "object", "left_semi").join(names.withColumnRenamed("_n", "subject"), "subject", "left_anti").select(*rows.columns)
    return hit.unionByName(other)


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, name: str = "name", sample_id: str | None = None, qualifiers: bool = False) -> DataFrame:
    """Distinct facts on nodes less than ``depth`` steps from the seeds, with their provenance.

    Each round joins only the new frontier. With qualifiers a fact also leads on to its qualifiers' objects, but not back from them.
    """
    rows = scoped(edges, sample_id)
    columns = [*FACT, *(["qualifiers"] if qualifiers else []), "source_text_id"]
    frontier = cut(seeds.select(F.col(name).alias("_n")).where("_n IS NOT NULL").distinct())
    visited, found = frontier, None
    for step in range(depth):
        facts = one_hop(rows, frontier, "_n").select(*columns)
        found = facts if found is None else found.union(facts)
        if step + 1 == depth:
            break
        facts = cut(facts)
        reached = facts.select(F.col("subject").alias("_n")).union(facts.select("object"))
        if qualifiers:
            reached = reached.union(facts.select(F.explode("qualifiers.object")))
        frontier = cut(reached.where("_n IS NOT NULL").distinct().join(visited, "_n", "left_anti"))
        visited = cut(visited.union(frontier))
    return found.distinct()


def simple_edges(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """Distinct (subject, object) pairs with both ends."""
    return edges.where("subject IS NOT NULL AND object IS NOT NULL").select(*group, "subject", "object").distinct()


def last_relation(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each (subject, object): the relation stored last."""
    spread(edges)
    return edges.where("subject IS NOT NULL AND object IS NOT NULL").groupBy("subject", "object").agg(F.max_by("relation", seq).alias("relation"))


def graph_size(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """nodes, edges and mean degree (a loop counts twice), 0 where empty."""
    return _named_groups(edges, _sizes(*numbered(edges, "subject", "object", group)[:2], group), group)


def _sizes(links: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """nodes, edges and mean degree by the group's number ``g``; one row without groups."""
    g = ["g"] if group else []
    counted = nodes.groupBy(*g).agg(F.count(F.lit(1)).alias("nodes"))
    owned = links.join(nodes.select(F.col("id").alias("u"), "g"), "u") if group else links
    drawn = owned.groupBy(*g).agg(F.count(F.lit(1)).alias("edges"))
    both = counted.join(drawn, g) if group else counted.join(drawn, F.lit(True))
    return both.withColumn("mean_degree", F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), F.lit(0.0)))


def _named_groups(edges: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """The group's columns in place of its number."""
    if not group:
        return found
    names = edges.where("subject IS NOT NULL AND object IS NOT NULL").select(*group).distinct().withColumn("g", group_number(group))
    return names.join(found, "g").drop("g")


def _clustering(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, g, degree, clustering) of numbered nodes.

    Edges lead from their end of lower degree, so that no node has more of them than the root of twice their number, and each triangle
    is found once: as a path of two edges and the edge that leads from its begin to its end.
    """
    flat = stored(links.where("u <> v").select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct(), "flat")
    degree = stored(flat.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degree")
    dx, dy = degree.select(F.col("id").alias("x"), F.col("degree").alias("dx")), degree.select(F.col("id").alias("y"), F.col("degree").alias("dy"))
    up = F.struct("dx", "x") < F.struct("dy", "y")
    directed = stored(flat.join(dx, "x").join(dy, "y").select(F.when(up, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(up, F.col("y")).otherwise(F.col("x")).alias("b")), "directed")
    paths = directed.join(directed.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    closed = paths.join(directed.select("a", F.col("b").alias("c")), ["a", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = F.coalesce("degree", F.lit(0))
    value = F.when(d < 2, F.lit(0.0)).otherwise(2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1)))
    return nodes.join(degree, "id", "left").join(corners, "id", "left").select("id", "g", d.alias("degree"), value.alias("clustering"))


def local_clustering(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """(node, degree, clustering) of the undirected simple graph; nodes with fewer than two neighbours have 0."""
    links, nodes, number = numbered(edges, "subject", "object", list(group))
    names = nodes_of(edges, "subject", "object", list(group)).withColumn("id", number("node"))
    return names.join(_clustering(links, nodes), "id").select(*group, "node", "degree", "clustering")


def statistics(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """nodes, edges, mean degree and mean clustering, of the whole graph or by group; names are read once, the rest is on numbers."""
    links, nodes, _ = numbered(edges, "subject", "object", list(group))
    size, mean = _sizes(links, nodes, list(group)), _clustering(links, nodes).groupBy(*(["g"] if group else [])).agg(F.avg("clustering").alias("clustering"))
    return _named_groups(edges, size.join(mean, "g") if group else size.join(mean, F.lit(True)), list(group))


def printed_statistics(edges: DataFrame) -> str:
    """The graph's totals as lines of text."""
    row = graph_size(edges).join(largest_component(edges), F.lit(True)).join(local_clustering(edges).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering")), F.lit(True)).first()
    return "\n".join(f"{name.replace('_', ' ')}: {value:.4f}" if isinstance(value, float) else f"{name.replace('_', ' ')}: {value}" for name, value in row.asDict().items())


def timing_means(timings: DataFrame) -> DataFrame:
    """(label, mean_ms, n) from (label, ms)."""
    return timings.groupBy("label").agg(F.avg("ms").alias("mean_ms"), F.count("ms").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node, lone ones with a loop included; a component is named by its least node."""
    links, _, number = numbered(edges, "subject", "object")
    found = nodes_of(edges, "subject", "object").withColumn("id", number("node")).join(roots(links), "id", "left")
    found = stored(found.select("node", F.coalesce("root", "id").alias("root"), F.col("root").isNull().alias("lone")), "components")
    least = found.where("NOT lone").groupBy("root").agg(F.min("node").alias("component"))
    return found.where("NOT lone").join(least, "root").select("node", "component").union(found.where("lone").select("node", "node"))


def _component_sizes(edges: DataFrame, group: list[str] = ()) -> DataFrame:
    """(g, n): the group's number and the nodes of each component of more than one node, and of one lone node a group."""
    links, nodes, _ = numbered(edges, "subject", "object", list(group))
    held = nodes.join(roots(links), "id", "left")
    sizes = held.where("root IS NOT NULL").groupBy("g", "root").agg(F.count(F.lit(1)).alias("n")).select("g", "n")
    return sizes.union(held.where("root IS NULL").groupBy("g").agg(F.max(F.lit(1).cast("long")).alias("n")))


def largest_component(edges: DataFrame) -> DataFrame:
    return _component_sizes(edges).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))


def sample_components(edges: DataFrame) -> DataFrame:
    """Largest component of each sample: nodes are told apart by sample, so one run serves all samples."""
    rows = edges.where("sample_id IS NOT NULL")
    largest = _component_sizes(rows, ["sample_id"]).groupBy("g").agg(F.max("n").alias("largest_component"))
    return _named_groups(rows, largest, ["sample_id"])


def alias_statistics(aliases: DataFrame, label: str = "label") -> DataFrame:
    """Rows, distinct labels and aliases a label; empty labels do not count."""
    rows = aliases.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("aliases"), F.count(F.lit(1)).alias("labels")).withColumn("aliases_per_label", F.coalesce(F.try_divide(F.col("aliases").cast("double"), F.col("labels")), F.lit(0.0)))


def shortened(text) -> F.Column:
    return F.when(F.length(text) > LABEL_WIDTH, F.concat(F.substring(text, 1, LABEL_WIDTH), F.lit("…"))).otherwise(text)


def _statements(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("qualifiers") > 0).withColumn("st", F.concat(F.lit("st:"), F.col("source_text_id")))


def reified_nodes(edges: DataFrame) -> DataFrame:
    """(id, label, kind): entities, and a statement node for each fact with qualifiers."""
    spread(edges)
    names = edges.select(F.col("subject").alias("n")).union(edges.select("object")).union(edges.select(F.explode("qualifiers.object"))).where("n IS NOT NULL").distinct()
    return names.select(F.concat(F.lit("e:"), "n").alias("id"), shortened(F.col("n")).alias("label"), F.lit("entity").alias("kind")).union(_statements(edges).select(F.col("st"), shortened(F.col("relation")), F.lit("statement")).distinct())


def reified_edges(edges: DataFrame) -> DataFrame:
    """(source, target, label): plain facts as one edge; qualified ones by way of their statement node."""
    spread(edges)
    entity = lambda c: F.concat(F.lit("e:"), c)
    plain = edges.where(F.size("qualifiers") == 0).select(entity(F.col("subject")).alias("source"), entity(F.col("object")).alias("target"), F.col("relation").alias("label"))
    held = _statements(edges)
    into = held.select(entity(F.col("subject")), F.col("st"), F.lit("subject of"))
    out = held.select("st", entity(F.col("object")), "relation")
    more = held.select("st", F.explode("qualifiers").alias("q")).select("st", entity(F.col("q.object")), F.col("q.relation"))
    return plain.union(into).union(out).union(more).distinct()


def plain_graph(edges: DataFrame, banned: str = "ITEM") -> DataFrame:
    """Edges of the plain view: names that hold the banned word are left out."""
    return edges.where(~F.col("subject").contains(banned) & ~F.col("object").contains(banned)).select("subject", "object", "relation").distinct()


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("subject") == node) | (F.col("object") == node))


def two_hop_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths of two facts in a row, spelled with arrows."""
    a, b = first.select(*FACT).distinct().alias("a"), second.select(*FACT).distinct().alias("b")
    return a.join(b, F.col("a.object") == F.col("b.subject")).select(F.concat_ws(" -> ", "a.subject", "a.relation", "a.object", "b.relation", "b.object").alias("path"))


def typed_paths(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Paths of facts in a row with the given relations, of any length, spelled with arrows."""
    found = None
    for i, relation in enumerate(relations):
        step = edges.where(F.col("relation") == relation).select(F.col("subject").alias("_from"), F.col("object").alias(f"_{i}")).distinct()
        if found is None:
            found = step.select(F.concat_ws(f" -> {relation} -> ", "_from", "_0").alias("path"), F.col("_0").alias("_end"))
        else:
            found = found.join(step, F.col("_end") == F.col("_from")).select(F.concat_ws(f" -> {relation} -> ", "path", f"_{i}").alias("path"), F.col(f"_{i}").alias("_end"))
    return found.select("path")


def path_tokens(paths: DataFrame) -> DataFrame:
    """(path, pos, token, is_relation): odd places are relations."""
    return paths.select("path", F.posexplode(F.split("path", " -> ")).alias("pos", "token")).withColumn("is_relation", F.col("pos") % 2 == 1)


def resolve_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts with alias names replaced by their canonical ones, once each. ``aliases``: alias, canonical."""
    spread(edges, aliases)
    names = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    s, o = (names.select(F.col("alias").alias(side), F.col("canonical").alias(f"c_{side}")) for side in ("subject", "object"))
    return edges.select(*FACT).join(s, "subject", "left").join(o, "object", "left").select(F.coalesce("c_subject", "subject").alias("subject"), "relation", F.coalesce("c_object", "object").alias("object")).distinct()
