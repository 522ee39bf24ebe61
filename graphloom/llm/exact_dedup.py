"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Only DataFrame functions run here. One pass writes each row's length and prefix hash; the lengths that occur more than once, and then
the (length, prefix) pairs among those, are found on these narrow rows alone. Whole texts are read once more, and the full hash is
evaluated only for rows whose pair another row shares; it alone decides. The pairs are broadcast when they are few enough by count
(``BROADCAST_ROWS``) and joined by a shuffle otherwise, with the same result.

Defined results: null text counts as empty; null ids sort after all others; a group of null ids keeps one row; of rows that repeat
both id and text one is kept; input columns other than id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checked_broadcast
from graphloom.session import cut, stored

#: Length of the hashed prefix in characters.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _head(text: Column) -> Column:
    """Length and first characters in one number."""
    return F.xxhash64(F.length(text), F.substring(text, 1, PREFIX))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """doc_id, _key (null for rows that are alone in length and prefix) and, with ``digest``, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    heads = stored(base.select(F.length("_text").alias("_l"), _head(F.col("_text")).alias("_p")), "exact-heads")
    lengths = cut(heads.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_l"))
    same_length = heads.join(checked_broadcast(lengths), "_l", "left_semi")
    shared = cut(same_length.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_p", F.lit(True).alias("_shared")))
    full = F.sha2("_text", 256)
    rows = base.withColumn("_p", _head(F.col("_text"))).join(checked_broadcast(shared), "_p", "left")
    return rows.select("doc_id", F.when(F.col("_shared"), full).alias("_key"), *([full.alias("text_sha256")] if digest else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (and text_sha256 with ``digest``, which hashes every text)."""
    rows = stored(_keyed(docs, id_col, text_col, digest), "exact-rows")
    alone = rows.where("_key IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *(["text_sha256"] if digest else []), F.lit(True).alias("kept"))
    # Rows that repeat id and text are counted here and expanded again at the end.
    rows = rows.where("_key IS NOT NULL")
    counted = rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    groups = cut(rows.groupBy("_key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = counted.join(groups, "_key").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", *(["text_sha256"] if digest else []), kept.alias("kept")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns.

    Rows are told apart by id, so only what is dropped has to meet the texts again. Of ids that occur more than once, null among them,
    there is no telling which row is meant; their rows are compared by id and full hash.
    """
    rows = stored(_keyed(docs, id_col, text_col, False), "exact-rows")
    often = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_often")))
    groups = cut(rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min("doc_id").alias("_keep")))
    members = rows.where("_key IS NOT NULL").join(groups, "_key")
    dropped = cut(members.where("NOT doc_id <=> _keep").select(F.col("doc_id").alias("_dropped")).distinct())
    own = docs[id_col]
    plenty = checked_broadcast(often)
    once = docs.join(plenty, own.eqNullSafe(plenty["_often"]), "left_anti")
    gone = checked_broadcast(dropped)
    once = once.join(gone, own.eqNullSafe(gone["_dropped"]), "left_anti")
    if often.isEmpty():
        return once
    digest = F.sha2(normalised(F.col(text_col)), 256)
    name = next(f"_{i}" for i in range(len(docs.columns) + 1) if f"_{i}" not in docs.columns)
    repeated = docs.join(plenty, own.eqNullSafe(plenty["_often"]), "left_semi").withColumn(name, digest).dropDuplicates([id_col, name])
    # A kept row of such an id leads its group, or is alone in length and prefix.
    leads = groups.select(F.col("_keep").alias("_lead"), F.col("_key").alias("_text"))
    in_group = groups.select(F.col("_key").alias("_text"))
    led = repeated.join(leads, repeated[id_col].eqNullSafe(leads["_lead"]) & (repeated[name] == leads["_text"]), "left_semi")
    alone = repeated.join(in_group, repeated[name] == in_group["_text"], "left_anti")
    return once.unionByName(led.unionByName(alone).drop(name))
