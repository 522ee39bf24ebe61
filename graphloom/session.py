"""Session helpers: local sessions for tests, and the shared folder that executors and driver can all reach."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if everything runs on this machine, else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = context.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again (column pruning and size statistics come for free)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    dropped_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote; nobody may read it again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Stored input that one shuffle partition may stand for, and the shuffled bytes up to which partitions are merged: they are compressed,
#: and a task that joins, sorts and aggregates them holds some twenty times as much.
PARTITION_BYTES, MERGED_BYTES = 2 << 20, "8m"
_MERGE_SETTING, _MERGE_DEFAULT = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "67108864b"


def spread(*frames: DataFrame) -> None:
    """Have the session deal as many shuffle partitions as these inputs need, so that a task's memory does not grow with them.

    The number is only ever raised, and adaptive execution merges what turns out small; a merge size that the session was given stays.
    """
    spark = frames[0].sparkSession
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < 1 << 50)  # beyond are inputs of unknown size
    if size // PARTITION_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // PARTITION_BYTES))
    if spark.conf.get(_MERGE_SETTING) in (_MERGE_DEFAULT, "64MB", "64m") and not spark.sparkContext.getConf().contains(_MERGE_SETTING):
        spark.conf.set(_MERGE_SETTING, MERGED_BYTES)


_SHIPPED: set[str] = set()
#: Arrow batches are cut by bytes, as texts may be long: of each batch several copies are held at once, in the JVM and in the worker.
BATCH_BYTES = "4m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever the driver found it; once for each application. Arrow batches get a bound."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT and not context.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)  # a value that the session was given stays
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        if top.is_dir():
            target = Path(tempfile.mkdtemp(prefix="graphloom-ship-")) / "graphloom.zip"
            with zipfile.ZipFile(target, "w") as archive:
                for source in sorted(top.rglob("*.py")):
                    archive.write(source, str(source.relative_to(top.parent)))
            context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
