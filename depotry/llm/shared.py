"""Files and tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; where that is unset on one machine
(tests, a laptop) a temporary folder is made and set; on a cluster it must be set. Everything an operator writes goes to one sub-folder, is
written under a temporary name and renamed, so a task that runs twice leaves the same file,
and a lost executor loses nothing that was written.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark sends a Python worker at once. Texts are long, so its default would hold tens of MB on both sides.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_CACHE: dict[tuple[str, str], np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(shutil.rmtree, urlparse(at).path, True)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows if they are larger."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(uri).path)
    return pafs.FileSystem.from_uri(uri)


class Workspace:
    """One run's own sub-folder of the shared folder; removed when the driver ends.

    Also lowers the session's Arrow batches to ``BATCH_ROWS`` rows if they are larger.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.uri = spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        fs, path = _fs(self.uri)
        fs.create_dir(path, recursive=True)
        atexit.register(self.remove)
        small_batches(spark)

    def table(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """``df`` written as Parquet and read again: cuts the lineage, survives lost executors.

        ``parts`` joins the many small parts that a shuffle leaves of little data, so that files
        follow the rows (see ``parts``) and not the number of shuffle partitions.
        """
        (df.coalesce(parts) if parts else df).write.mode("overwrite").parquet(f"{self.uri}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.uri}/{name}")

    def parts(self, rows: int, each: int) -> int:
        """Parts for a table of so many rows: at least one for each core, else ``each`` rows in one."""
        return max(self.spark.sparkContext.defaultParallelism, rows // each)

    def folder(self, name: str) -> str:
        fs, path = _fs(f"{self.uri}/{name}")
        fs.create_dir(path, recursive=True)
        return f"{self.uri}/{name}"

    def remove(self, name: str = "") -> None:
        try:
            fs, path = _fs(f"{self.uri}/{name}".rstrip("/"))
            fs.delete_dir(path)
        except OSError:
            pass


def put_array(uri: str, values: np.ndarray) -> None:
    """Write one array under a temporary name, then rename it."""
    fs, path = _fs(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(pa.py_buffer(np.ascontiguousarray(values)))
    fs.move(part, path)


def get_array(uri: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped. From a store without local files a worker maps its own copy.

    A worker keeps the maps of one folder; those of another operator's go, for a file that is
    deleted but mapped still takes its place on the disk.
    """
    if (got := _CACHE.get((uri, dtype))) is not None:
        return got
    if _CACHE and next(iter(_CACHE))[0].rpartition("/")[0] != uri.rpartition("/")[0]:
        _CACHE.clear()
    fs, path = _fs(uri)
    size = fs.get_file_info(path).size
    if not size:
        return np.zeros(0, dtype)
    if not isinstance(fs, pafs.LocalFileSystem):
        with fs.open_input_stream(path) as src, tempfile.NamedTemporaryFile(delete=False) as to:
            shutil.copyfileobj(src, to)
        path = to.name
    got = np.memmap(path, dtype, "r")
    if not isinstance(fs, pafs.LocalFileSystem):
        os.unlink(path)
    _CACHE[uri, dtype] = got
    return got


def split_sorted(keys: np.ndarray, shards: int) -> np.ndarray:
    """Offsets of the ``shards`` equal ranges of the 64-bit space in sorted ``keys``."""
    return np.concatenate(([0], np.searchsorted(keys, shard_starts(shards)[1:]), [len(keys)]))


def shard_starts(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(shards)], np.uint64)


def text_bytes(docs: DataFrame, column: str | Column = "text") -> int:
    """Bytes of all texts; sizes the shards, nothing else."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Keys that can count as hot: each has at least this fraction of all rows.
HOT_KEYS, LEAST_HOT = 1000, 256


def join_by_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; ``table`` has a row a key, ``weight`` is the number of rows with that key.

    Keys with many rows would put them all into one task. Those with a thousandth of all rows are
    at most ``HOT_KEYS``, whatever the data, so they are broadcast and their rows stay where they
    are; the others are joined by shuffle. ``table`` should lie written, as it is read three times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(LEAST_HOT, total // HOT_KEYS)
    hot, cold = table.where(F.col(weight) >= least), table.where(F.col(weight) < least)
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(left.join(cold, key))


_LOCK = threading.Lock()
_ONCE: dict[str, object] = {}


def once(key: str, make):  # noqa: ANN001, ANN201
    """A worker's own object, made at its first use."""
    with _LOCK:
        if key not in _ONCE:
            _ONCE[key] = make()
        return _ONCE[key]


def forget() -> None:
    """Drop a worker's own objects and what Arrow keeps of freed batches: workers live on between operators, and memory is theirs all the while."""
    with _LOCK:
        _ONCE.clear()
    pa.default_memory_pool().release_unused()
