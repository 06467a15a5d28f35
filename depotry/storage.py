"""Cutting lineage on the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table under the session's checkpoint folder and read again.

    Later steps then neither repeat it nor plan it again, and plan with its true size: a loop whose
    plans only estimate sizes of sizes soon estimates numbers of many digits. The folder is the
    session's ``spark.checkpoint.dir``. On one machine a temporary folder serves where that is unset;
    elsewhere executors could not see it, so it must be set. What is written goes when the driver ends.
    """
    at = new_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def new_folder(spark: SparkSession) -> str:
    """Name of a folder of one's own on the shared checkpoint folder; it goes when the driver ends."""
    return f"{_folder(spark)}/{uuid.uuid4().hex[:16]}"


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _FOLDERS.get(context.applicationId) or f"file://{tempfile.mkdtemp(prefix='cut-')}"
        _FOLDERS.setdefault(context.applicationId, shared)
    key = f"{context.applicationId} {shared}"
    if key not in _FOLDERS:
        shared = shared if ":" in shared else f"file://{os.path.abspath(shared)}"
        _FOLDERS[key] = f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, _FOLDERS[key])
    return _FOLDERS[key]


def _remove(uri: str) -> None:
    if uri.startswith("file:"):
        shutil.rmtree(unquote(urlparse(uri).path), ignore_errors=True)
        return
    try:
        store, path = fs.FileSystem.from_uri(uri)
        store.delete_dir(path)
    except (OSError, ValueError):  # a store that only Spark reaches keeps its checkpoints, as Spark does
        pass
