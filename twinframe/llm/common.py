"""Shared plumbing: column selection, shared-folder tables and byte-level file access from executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.sources import rows

#: The six ASCII white-space characters: space and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
#: Arrow rows per batch handed to Python, so that a batch of long texts stays a few tens of MB.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, whose bytes Spark bounds (64 MB): the lists that workers make of a batch take several times its size.

    Workers find this package where the driver found it (on a cluster: installed, or sent with --py-files).
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A URI in the folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="twinframe-")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return root.rstrip("/")


_local: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/twinframe/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a Parquet table in the shared folder, which survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = weakref.ref(table), path
    return table


_paths: dict[int, tuple[weakref.ref, str]] = {}


def numbered(df: DataFrame, column: str) -> DataFrame:
    """The rows with a number of their own that stays the same in every later reading, by any number of cores.

    Rows of Parquet files are known by file and place there, without a copy; anything else is written to the shared folder first.
    """
    return rows.numbered(df, column, lambda d: written(d, "rows"))


#: Up to so many row numbers (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000


def without(kept: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The numbered rows whose number isn't in ``gone`` (distinct), without the number. Texts are shuffled only if too many go to broadcast."""
    gone = written(gone, "gone")
    return kept.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, column, "left_anti").drop(column)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once all that was made of them is written itself."""
    for df in tables:
        known = _paths.pop(id(df), None)
        if known is not None and known[0]() is df:
            drop_path(df.sparkSession, known[1])
            _made.remove((df.sparkSession, known[1]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions for so many rows: never under the session's own number, and growing with the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)
