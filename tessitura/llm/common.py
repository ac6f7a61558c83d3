"""What the operators of this subpackage share: the scratch store, word rules, Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every word and key rule here: space and U+0009 to U+000D.
# bytes.split() and bytes.strip() without arguments use the same set, and bytes.lower() lowers A-Z alone.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[tuple[str, str], list[str]] = {}  # by application and owner: folders to delete when the owner starts anew
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessitura-')}")
    return sc.getCheckpointDir().rstrip("/")


def _store(spark: SparkSession, path: str):
    """A path of a store, as the JVM's objects: its file system and itself."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's path. What stands there is deleted when its owner starts anew, or with the session."""
    folder = f"{scratch_root(spark)}/llm-{uuid.uuid4().hex}"
    if owner := _owner.get():
        _written.setdefault((spark.sparkContext.applicationId, owner), []).append(folder)
    store, at = _store(spark, folder)
    store.mkdirs(at)  # only what exists can be marked
    store.deleteOnExit(at)
    return f"{folder}/{label}"


def delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


@contextlib.contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Scratch written inside belongs to `owner`; what the same owner wrote the last time is deleted first.

    For callers that store a result before they start anew. Nobody else's scratch is touched.
    """
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        delete(spark, path)
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def durable(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and kept in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, so that very long texts don't gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(rows_or_bytes: int, each: int) -> int:
    """How many partitions hold `each` units at most; grows in proportion to the input, without an upper limit."""
    return max(1, -(-int(rows_or_bytes or 0) // each))
