"""What the operators of this package share: the shared folder, safe column use, joins by document."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_own: dict[str, str] = {}
_stashed: list[str] = []  #: the folders of this process' stashed tables, in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests) gets a temporary
    folder of its own; a cluster session is refused, as a machine-local folder
    would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="sieveloom-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return _own[key]


def stash(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveloom-{uuid.uuid4().hex}"
    _stashed.append(path)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stash(*frames: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more; a table that wasn't stashed here stays."""
    for df in frames:
        folders = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
        for path in [p for p in _stashed if os.path.basename(p) in folders]:
            _delete(df.sparkSession, path)
            _stashed.remove(path)


def stash_mark() -> int:
    """A point in time for ``drop_stashes``."""
    return len(_stashed)


def drop_stashes(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what was stashed after a mark, for when every result that reads it is written; ``keep`` stays."""
    kept = {os.path.basename(os.path.dirname(f)) for f in keep.inputFiles()} if keep is not None else set()
    for path in _stashed[since:]:
        if os.path.basename(path) not in kept:
            _delete(spark, path)
    _stashed[since:] = [p for p in _stashed[since:] if os.path.basename(p) in kept]


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator needs, so that other columns, whatever their names, are out of the way.

    Rows without ``doc_id`` can't be named in a result and are left out.
    """
    return docs.select("doc_id", *columns).where(F.col("doc_id").isNotNull())


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the documents whose ``doc_id`` is in ``dropped``; all columns and row multiplicities stay.

    The ids are the hash-joined build side; only their partition's share is in
    memory, and no text is sorted. Rows without ``doc_id`` stay.
    """
    ids = dropped.select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("__dropped_id"), "left_anti")


def slices(x: np.ndarray, n: int) -> pa.RecordBatch:
    """A vector in ``n`` slices, as ``tree_sum`` takes them."""
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(n), pa.int32()), "part": pa.array([p.tobytes() for p in np.array_split(x.reshape(-1), n)], pa.binary())})


def tree_sum(parts: DataFrame, dtype: str, size: int, fan: int = 64) -> np.ndarray:
    """The sum of vectors of which each partition of ``parts`` (slice int, part binary) gives at most one.

    They meet in a tree: a group holds the slices of ``fan`` partitions, however many there are. They are added in order, so the sum is the same at every run.
    """

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(group["at"].to_numpy(), kind="stable").tolist()
        total = np.zeros(len(group["part"][0].as_buffer()) // np.dtype(dtype).itemsize, dtype)
        for k in order:
            total += np.frombuffer(group["part"][k].as_buffer(), dtype)
        return pa.table({"slice": pa.array([group["slice"][0].as_py()], pa.int32()), "at": pa.array([group["to"][0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    n, parts = parts.rdd.getNumPartitions(), parts.withColumn("at", F.spark_partition_id())
    while True:
        parts, n = parts.withColumn("to", F.floor(F.col("at") / fan).cast("int")).groupBy("slice", "to").applyInArrow(add, "slice int, at int, part binary"), -(-n // fan)
        if n <= 1:
            break
    got = parts.orderBy("slice").collect()
    return np.concatenate([np.frombuffer(r["part"], dtype) for r in got]) if got else np.zeros(size, dtype)
