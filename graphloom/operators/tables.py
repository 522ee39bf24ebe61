"""Keyed upserts, provisioning and dumps over a catalog of Parquet tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.session import cut, spread


def first_per_key(df: DataFrame, key: list[str], seq: str, last: bool = False) -> DataFrame:
    """One row for each key (nulls are equal): the one with the least, or the greatest, ``seq``.

    An aggregate, so rows of one key are combined before they are shuffled and a frequent key is no bottleneck.
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*key).agg(pick(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str, policy: str = "first") -> DataFrame:
    """Insert-if-absent (``first``) or replace (``last``) by key; null key parts are equal to each other."""
    if policy not in ("first", "last"):
        raise ValueError(f"unknown policy {policy}")
    batch = first_per_key(new, key, seq, policy == "last")
    kept, added = (old, batch) if policy == "first" else (batch, old)
    left, right = added.alias("l"), kept.select(*key).alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return kept.unionByName(left.join(right, on, "left_anti"), allowMissingColumns=True)


def document_id(collection: str, columns: list[str]) -> F.Column:
    """A stable id of a row's payload; a null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("\u0001", F.lit(collection), *parts), 256), 1, 32)


def stamp_sample(df: DataFrame, sample_id: str | None, structured: bool = True) -> DataFrame:
    """Set the sample; in structured mode an empty one is ``all``."""
    return df.withColumn("sample_id", F.lit(sample_id or "all") if structured else F.lit(sample_id).cast("string"))


def delete_sample(df: DataFrame, sample_id: str) -> DataFrame:
    """Rows of other samples; a table without samples (aliases of dynamic properties) stays whole."""
    return df.where(~F.col("sample_id").eqNullSafe(F.lit(sample_id))) if "sample_id" in df.columns else df


def pending_passages(passages: DataFrame, done: DataFrame) -> DataFrame:
    """Passages with words of which no triplet is stored yet."""
    return passages.where(F.length(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))) > 0).join(done.select("sample_id", "source_text_id").distinct(), ["sample_id", "source_text_id"], "left_anti")


def stage_union(stages: dict[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _staged(stages: dict, rows: DataFrame | None) -> tuple[DataFrame, dict[str, F.Column]]:
    """Rows with sample and source, and for each stage whether a row is of it.

    ``stages`` holds a table for each stage; or, with ``rows``, a condition on this one table, which is then read and shuffled once
    however many of its stages a row belongs to.
    """
    if rows is None:
        rows = stage_union(stages)
        stages = {s: F.col("stage") == s for s in stages}
    spread(rows)
    return rows.where("sample_id IS NOT NULL AND source_text_id IS NOT NULL"), {s: F.coalesce(c, F.lit(False)) for s, c in stages.items()}


def dump_counts(stages: dict, rows: DataFrame | None = None) -> DataFrame:
    """Rows by sample, source and stage; rows without sample or source are left out."""
    rows, marks = _staged(stages, rows)
    rows = rows.select("sample_id", "source_text_id", *[c.alias(s) for s, c in marks.items()]).where(" OR ".join(f"`{s}`" for s in marks))
    return rows.groupBy("sample_id", "source_text_id").agg(*[F.count_if(F.col(s)).alias(s) for s in sorted(marks)])


def dump(stages: dict, fields: tuple[str, ...] = schemas.EXPORT_FIELDS, samples: int | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(sample_id, source_text_id, json): the lists of each stage for one passage, of the first ``samples`` samples if asked; absent
    fields are left out of the JSON."""
    rows, marks = _staged(stages, rows)
    fact = F.struct(*[f for f in fields if f in rows.columns])
    rows = rows.select("sample_id", "source_text_id", F.struct(fact.alias("fact"), F.struct(*[c.alias(s) for s, c in marks.items()]).alias("of")).alias("_f")).where(" OR ".join(f"_f.of.`{s}`" for s in marks))
    if samples is not None:
        rows = rows.join(rows.select("sample_id").distinct().orderBy("sample_id").limit(samples), "sample_id", "left_semi")
    listed = rows.groupBy("sample_id", "source_text_id").agg(F.sort_array(F.collect_list("_f")).alias("_l"))
    of = lambda stage: F.transform(F.filter("_l", lambda x: x["of"][stage]), lambda x: x["fact"]).alias(stage)
    lists = [of(s) for s in marks]
    return listed.select("sample_id", "source_text_id", F.to_json(F.struct(*lists)).alias("json"))


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


@dataclass(frozen=True)
class VectorIndex:
    """What a search may ask of a table: its vector column, their dimension and the measure."""

    table: str
    column: str
    dims: int
    metric: str = "cosine"


@dataclass
class Catalog:
    """Tables as folders below ``root``, each in ``buckets`` parts that have versions of their own.

    Rows are dealt by a hash of their sample, or of the first key column where a table has no samples. An upsert or append reads and
    rewrites only the parts that its rows fall into. A part's new version counts once it is marked complete; the one before it stays
    for readers that have begun.
    """

    spark: SparkSession
    root: str
    mode: str = "structured"
    buckets: int = 64
    indexes: dict[str, list[str]] = field(default_factory=dict)
    vector_indexes: dict[str, VectorIndex] = field(default_factory=dict)

    def __post_init__(self) -> None:
        fs, path = self._fs()
        if fs.exists(path(self._record)):
            held = json.loads(self.spark.read.text(self._record, wholetext=True).first()[0])
            self.indexes = held["indexes"] | self.indexes
            self.vector_indexes = {name: VectorIndex(**v) for name, v in held["vector_indexes"].items()} | self.vector_indexes

    @property
    def _record(self) -> str:
        return f"{self.root}/_record/indexes.json"

    def _save(self) -> None:
        """Keep what was recorded of indexes for the next session."""
        fs, path = self._fs()
        out = fs.create(path(self._record), True)
        out.write(bytearray(json.dumps({"indexes": self.indexes, "vector_indexes": {n: asdict(v) for n, v in self.vector_indexes.items()}}), "utf-8"))
        out.close()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self, where: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(where)) if s.isDirectory()) if fs.exists(path(where)) else []

    def names(self) -> list[str]:
        return [name for name in self._folders(self.root) if not name.startswith("_")]

    def parts(self, name: str) -> dict[str, list[int]]:
        """The complete versions of each part; the part ``schema`` holds no rows."""
        fs, path = self._fs()
        found = {}
        for part in self._folders(f"{self.root}/{name}"):
            versions = [int(v[1:]) for v in self._folders(f"{self.root}/{name}/{part}") if fs.exists(path(f"{self.root}/{name}/{part}/{v}/_SUCCESS"))]
            if versions:
                found[part] = sorted(versions)
        return found

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        parts = self.parts(name)
        if not parts:
            raise KeyError(f"no table {name}")
        wanted = [f"{self.root}/{name}/{part}/v{versions[-1]}" for part, versions in parts.items() if only is None or part == "schema" or int(part[1:]) in only]
        return self.spark.read.option("mergeSchema", "true").parquet(*wanted)

    def bucket(self, columns: list[str], key: list[str] | None = None) -> F.Column:
        own = "sample_id" if "sample_id" in columns else (key or columns)[0]
        return F.pmod(F.xxhash64(F.coalesce(F.col(own).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _replace(self, name: str, rows: DataFrame, bucket: F.Column, touched: set[int] | None = None) -> None:
        """Put new versions of the parts in place; touched parts without rows become empty."""
        fs, path = self._fs()
        rough = f"{self.root}/_new-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(rough)
        versions = self.parts(name)
        made = {int(f.split("=")[1]) for f in self._folders(rough) if f.startswith("_bucket=")}
        if "schema" not in versions or not set(rows.columns) <= set(self.read(name, set()).columns):
            self.spark.createDataFrame([], rows.schema).write.parquet(f"{self.root}/{name}/schema/v{versions.get('schema', [-1])[-1] + 1}")
        for b in sorted(made | (touched or set())):
            part = f"b{b:04d}"
            home, new = f"{self.root}/{name}/{part}", versions.get(part, [-1])[-1] + 1
            if b in made:
                fs.mkdirs(path(home))
                fs.delete(path(f"{home}/v{new}"), True)  # left there by a writer that did not end
                if not fs.rename(path(f"{rough}/_bucket={b}"), path(f"{home}/v{new}")):
                    raise OSError(f"cannot move {rough}/_bucket={b} to {home}/v{new}")
                fs.create(path(f"{home}/v{new}/_SUCCESS"), True).close()
            elif part in versions:
                self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{home}/v{new}")
            for old in versions.get(part, [])[:-1]:
                fs.delete(path(f"{home}/v{old}"), True)
        fs.delete(path(rough), True)

    def write(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """Replace the whole table."""
        self._replace(name, df, self.bucket(df.columns, key), {int(p[1:]) for p in self.parts(name) if p != "schema"})

    def provision(self, names: tuple[str, ...] | None = None, drop: bool = False) -> None:
        """Create the missing tables of the mode, empty and typed; ``drop`` empties the named ones only."""
        for name in names or schemas.MODE_TABLES[self.mode]:
            if drop:
                self.drop(name)
            if not self.exists(name):
                kind = "dynamic_property_aliases" if name == "property_aliases" and self.mode == "dynamic" else name
                self.write(name, self.spark.createDataFrame([], schemas.SCHEMAS[kind]))

    def missing(self, required: tuple[str, ...]) -> list[str]:
        return sorted(set(required) - set(self.names()))

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/{name}"), True)

    def create_indexes(self, name: str, fields: list[str]) -> None:
        """Recorded for introspection only; scans prune by statistics."""
        self.indexes[name] = sorted({*self.indexes.get(name, []), *fields})
        self._save()

    def ensure_vector_index(self, name: str, column: str, dims: int, metric: str = "cosine") -> bool:
        """Record the vectors of a table; whether a record that did not fit was replaced."""
        new, old = VectorIndex(name, column, dims, metric), self.vector_indexes.get(name)
        self.vector_indexes[name] = new
        self._save()
        return old is not None and old != new

    def append(self, name: str, df: DataFrame) -> None:
        rows = cut(df)
        bucket = self.bucket(df.columns)
        touched = self._touched(rows, bucket)
        self._replace(name, self.read(name, touched).unionByName(rows, allowMissingColumns=True), bucket, touched)

    def upsert(self, name: str, df: DataFrame, key: list[str], seq: str | None = None, policy: str = "first") -> None:
        """Rows without an order column are ordered by a hash of their content, so that a repeated batch gives the same."""
        rows = cut(df if seq else df.withColumn("_seq", F.xxhash64(*[c for c in df.columns])))
        bucket = self.bucket(df.columns, key)
        touched = self._touched(rows, bucket)
        merged = upsert(self.read(name, touched), rows, key, seq or "_seq", policy)
        self._replace(name, merged.select(*[c for c in merged.columns if c not in ("_seq", seq)]), bucket, touched)

    def _touched(self, rows: DataFrame, bucket: F.Column) -> set[int]:
        return {b for (b,) in rows.select(bucket).distinct().collect()}  # at most ``buckets`` numbers

    def delete_sample(self, name: str, sample_id: str) -> None:
        """Delete one sample's rows; only its part is rewritten."""
        rows = self.read(name, set())
        if "sample_id" not in rows.columns:
            return
        bucket = self.bucket(rows.columns)
        touched = self._touched(self.spark.createDataFrame([(sample_id,)], "sample_id string"), bucket)
        self._replace(name, delete_sample(self.read(name, touched), sample_id), bucket, touched)

    def check_dimensions(self, name: str, dims: int, column: str = "alias_text_embedding") -> bool:
        """Whether all stored vectors have ``dims`` components."""
        low, high = self.read(name).agg(F.min(F.size(column)), F.max(F.size(column))).first()
        return low is None or low == high == dims

    def drop_incompatible(self, dims: int) -> list[str]:
        """Empty all tables of the mode if one of them holds vectors of another dimension; the names of those that do."""
        held = [n for n in schemas.MODE_TABLES[self.mode] if self.exists(n) and "alias_text_embedding" in self.read(n, set()).columns]
        found = [n for n in held if not self.check_dimensions(n, dims)]
        if found:
            self.provision(drop=True)
        return found

    @property
    def local(self) -> bool:
        return urlparse(self.root).scheme in ("", "file")


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
