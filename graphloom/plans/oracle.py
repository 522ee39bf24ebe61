"""Common table expressions for the SQL counterparts: the driver tables as a knowledge graph, and the small ontology."""

from __future__ import annotations

from graphloom.sources.fixtures import PROPERTIES, SUBCLASS_EDGES, TYPES

KG = """
nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cus AS (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nat ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, o_orderstatus, o_orderdate, c_name, r_name FROM orders JOIN cus ON o_custkey = c_custkey),
kg AS (
  SELECT c_name AS subject, 'located in country' AS relation, n_name AS object, 'customer' AS subject_type, 'country' AS object_type, r_name AS sample_id,
    'customer:' || c_custkey AS source_text_id, 1000000000000000 + c_custkey AS seq, CAST([] AS STRUCT(relation VARCHAR, object VARCHAR)[]) AS qualifiers, false AS returned FROM cus
  UNION ALL SELECT s_name, 'located in country', n_name, 'supplier', 'country', r_name, 'supplier:' || s_suppkey, 2000000000000000 + s_suppkey, [], false FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part of region', r_name, 'country', 'region', r_name, 'nation:' || n_nationkey, 3000000000000000 + n_nationkey, [], false FROM nat
  UNION ALL SELECT 'Order#' || o_orderkey, 'placed by', c_name, 'order', 'customer', r_name, 'orders:' || o_orderkey, 4000000000000000 + o_orderkey,
    [{'relation': 'point in time', 'object': strftime(o_orderdate, '%Y-%m-%d')}, {'relation': 'status', 'object': o_orderstatus}], false FROM ord
  UNION ALL SELECT 'Order#' || l_orderkey, 'contains', 'Part#' || l_partkey, 'order', 'part', r_name, 'lineitem:' || l_orderkey || '-' || l_linenumber,
    5000000000000000 + l_orderkey * 100 + l_linenumber, [{'relation': 'quantity', 'object': CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)}], l_returnflag = 'R'
    FROM lineitem JOIN ord ON l_orderkey = o_orderkey
),
tri AS (SELECT * FROM kg WHERE NOT returned)"""

VEC = """
va AS (SELECT vec_id, 'V' || vec_id AS alias, 'L' || label AS label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS entity_type,
  'S' || (vec_id % 4) AS sample_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, q.sample_id AS q_sample, q.entity_type AS q_type, a.vec_id, a.label, a.sample_id, a.entity_type, round(list_cosine_similarity(q.v, a.v), 9) AS score
  FROM va q JOIN va a ON true WHERE q.vec_id % 100 = 0)"""


def _list(values: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


ONTOLOGY = (
    "ty AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{label}', {_list(parents)})" for i, label, parents in TYPES) + ") t(entity_type_id, label, parent_type_ids)),\n"
    "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{label}', {_list(s)}, {_list(o)})" for i, label, s, o in PROPERTIES) + ") t(property_id, label, ss, oo)),\n"
    "inv AS (SELECT property_id, true AS subj, unnest(CASE WHEN list_contains(ss, 'Q186408') THEN ['Q186408'] WHEN list_contains(ss, 'Q309314') THEN ['Q309314'] ELSE ss END) AS ty FROM pr\n"
    "  UNION ALL SELECT property_id, false, unnest(CASE WHEN list_contains(oo, 'Q186408') THEN ['Q186408'] WHEN list_contains(oo, 'Q309314') THEN ['Q309314'] ELSE oo END) FROM pr),\n"
    "up AS (SELECT entity_type_id, unnest(list_concat([entity_type_id, 'ANY'], parent_type_ids)) AS via FROM ty),\n"
    "vp AS (SELECT DISTINCT u.entity_type_id, i.subj, i.property_id FROM up u JOIN inv i ON u.via = i.ty)"
)
EDGES = "ed AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SUBCLASS_EDGES) + ") t(child, parent))"
