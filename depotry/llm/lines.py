"""Corpus-wide line dedup over levelled sorted runs of line hashes.

``LineIndex`` keeps what batches of documents have shown so far, as runs of (key hash,
documents): tables bucketed by the hash and sorted by it within each bucket. All runs have the
same buckets, so a bucket of one run is merged with the same bucket of another as it lies there,
without a shuffle or a sort of either. Every level holds up to ``fanout`` runs; a full level is
merged into one run of the next, so an index of n batches has O(log n) runs and each entry is
rewritten O(log n) times. A new batch is shuffled once, to the buckets, and merge-anti-joined with
the runs: keys that the index already holds as common are left out, the batch's other keys become
a run of level 0.

``dedup_lines`` feeds every document through an index in batches and drops the lines of all
keys found in at least ``min_docs`` documents, in every document. A key is a line stripped of
``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys of fewer than ``min_chars`` code points stay.

Defined cases: null or empty text is one empty line; repeated rows are documents of their own;
an empty table gives no rows; texts of any length are split whole; extra columns are kept, but for
ones named as results (in any case). Keys are 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from depotry.llm.shared import Workspace, forget, get_array, put_array
from depotry.llm.textscan import text_buffers

#: Keys behind one bucket of a run, and the most buckets that Spark takes.
RUN_PART, MOST_BUCKETS = 500_000, 100_000
#: Keys that a task counts before it sends what it has.
HELD = 200_000
SPACE = b" \t\n\x0b\x0c\r"
#: Common keys up to this number (16 bytes each) are memory-mapped by every worker; more are joined by shuffle.
MOST_MAPPED = 1_000_000
RESULTS = ("n_lines", "n_dropped", "kept")


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and each one's key hash, None where the line always stays."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        enough = key and (min_chars <= 1 or len(key.decode()) >= min_chars)
        keys.append(hashlib.blake2b(key, digest_size=16).digest() if enough else None)
    return lines, keys


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = text_buffers(batch.column(column))
    for r in range(batch.num_rows):
        yield data[offsets[r] : offsets[r + 1]].tobytes()


class LineIndex:
    """Levelled sorted runs of (key, documents); ``fanout`` runs of a level are merged into one."""

    def __init__(self, spark: SparkSession, work: Workspace, min_docs: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.work, self.min_docs, self.fanout = spark, work, min_docs, fanout
        self.buckets = min(MOST_BUCKETS, buckets or spark.sparkContext.defaultParallelism)
        self.levels: list[list[str]] = [[]]
        # A bucket that is one file is read in the order in which it was written.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _run(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.work.uri}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.remove(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs added up, bucket by bucket.

        The filter lets every row pass. It makes rows of the scan's columns: a union of rows keeps
        the buckets of its inputs side by side, while one of columns says so but does not (Spark 4.1).
        """
        whole, *others = (self.spark.table(name).where("documents > 0") for name in names)
        for run in others:
            whole = whole.unionByName(run)
        return whole if len(names) == 1 else whole.groupBy("key").agg(F.sum("documents").alias("documents"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """(key, documents) of a batch, without the keys that a run already holds as common."""
        counts = keys.repartition(self.buckets, "key").groupBy("key").agg(F.sum("documents").alias("documents"))
        for run in self.runs():
            counts = counts.join(run.where(F.col("documents") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        return counts

    def add(self, keys: DataFrame) -> None:
        """Add a batch of ``keys``: counted (key, documents) or one row for each document that holds a key."""
        self.levels[0].append(self._run(self.unseen(keys if "documents" in keys.columns else keys.withColumn("documents", F.lit(1).cast("long")))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._run(self._merged(old))
            self.levels[level] = []
            for name in old:
                self._drop(name)
            if len(self.levels) == level + 1:
                self.levels.append([])
            level += 1
            self.levels[level].append(merged)

    def common(self) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "key binary")
        return self._merged(names).where(F.col("documents") >= self.min_docs).select("key")

    def close(self) -> None:
        """Drop the runs."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]


def document_keys(docs: DataFrame, batches: int, min_chars: int, text: str = "text") -> DataFrame:
    """(batch, key, documents): documents that hold a key, counted by task; a document goes to one batch whole."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        n = 0

        def flush() -> pa.RecordBatch:
            rows = [(number, k, c) for number, own in held.items() for k, c in own.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["batch", "key", "documents"])

        for part in parts:
            for number, body in zip(part.column(0).to_pylist(), _texts(part, 1), strict=True):
                own = held[number]
                n -= len(own)
                for k in {k for k in line_keys(body, min_chars)[1] if k}:
                    own[k] += 1
                n += len(own)
                if n >= HELD:
                    yield flush()
                    n = 0
        yield flush()

    number = F.pmod(F.xxhash64(F.col(text)), F.lit(batches)).cast("int")
    return docs.select(number.alias("batch"), F.col(text).cast("string").alias("text")).mapInArrow(run, "batch int, key binary, documents long")


def sorted_file(keys: DataFrame, uri: str) -> None:
    """One task writes the keys as a sorted array of 16 bytes each; for keys of a checked number."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(k for part in parts for k in part.column(0).to_pylist())
        put_array(uri, np.frombuffer(raw, ">u8").astype(np.uint64))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(raw) // 16], pa.int64())})

    keys.coalesce(1).sortWithinPartitions("key").mapInArrow(run, "n long").collect()  # one row


def _dropper(uri: str | None, min_chars: int, out: Callable) -> Callable:
    """mapInArrow function: ``out(lines, dropped)`` for the documents in column 0, from the mapped keys or those in column 1."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = get_array(uri, "V16") if uri else None
        for part in parts:
            rows = [line_keys(body, min_chars) for body in _texts(part, 0)]
            flat = [k for _, keys in rows for k in keys if k]
            if uri:
                known = np.frombuffer(b"".join(flat), ">u8").reshape(-1, 2).astype(np.uint64)
                found = _member(known, mapped)
                gone = iter(found.tolist())
                drops = [[k is not None and next(gone) for k in keys] for _, keys in rows]
            else:
                sets = [set(x or ()) for x in part.column(1).to_pylist()]
                drops = [[k is not None and k in s for k in keys] for (_, keys), s in zip(rows, sets, strict=True)]
            made = [out(lines, drop) for (lines, _), drop in zip(rows, drops, strict=True)]
            n, dropped, kept = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["rest", *RESULTS])

    return run


def _member(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Which 128-bit keys (two columns) are in the mapped ones, sorted by first, then second half."""
    if not len(sorted_keys) or not len(keys):
        return np.zeros(len(keys), bool)
    table = sorted_keys.view(np.uint64).reshape(-1, 2)
    high = table[:, 0]
    at, end = np.searchsorted(high, keys[:, 0]), np.searchsorted(high, keys[:, 0], "right")
    found = np.zeros(len(keys), bool)
    while (live := at < end).any():
        found[live] |= table[at[live], 1] == keys[live, 1]
        at = at + 1
    return found


def kept_text(lines: list[bytes], drop: list[bool]) -> tuple[int, int, str]:
    kept = [line for line, gone in zip(lines, drop, strict=True) if not gone]
    return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()


def kept_digest(lines: list[bytes], drop: list[bool]) -> tuple[int, int, str]:
    kept = [line for line, gone in zip(lines, drop, strict=True) if not gone]
    return len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 5, fanout: int = 4, text: str = "text", digest: bool = False, most_mapped: int = MOST_MAPPED) -> DataFrame:
    """The columns of ``docs`` but for its text, with n_lines, n_dropped and ``kept``.

    ``kept`` is the text without its common lines, or with ``digest`` its SHA-256.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "lines")
    keys = work.table(document_keys(docs, batches, min_chars, text), "keys")
    index = LineIndex(spark, work, min_docs, fanout, work.parts(keys.count(), RUN_PART))
    for number in range(batches):
        index.add(keys.where(F.col("batch") == number).select("key", "documents"))
    common, uri = work.table(index.common(), "common", work.parts(0, 1)), None
    index.close()
    work.remove("keys")
    out = kept_digest if digest else kept_text
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    held = docs.select(F.col(text).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest), *([] if rest else [F.lit(0).alias("none")])).alias("rest"))
    if common.limit(most_mapped + 1).count() <= most_mapped:
        uri = f"{work.uri}/common.bin"
        sorted_file(common, uri)
        shaped = held.select("text", F.lit(None).cast("array<binary>").alias("keys"), "rest")
    else:
        numbered = work.table(held.withColumn("row", F.monotonically_increasing_id()), "numbered")
        own = document_rows(numbered, min_chars).join(common, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))  # a document's own keys
        shaped = numbered.join(own, "row", "left").select("text", "keys", "rest")
    schema = StructType([shaped.schema["rest"], *(StructField(n, t) for n, t in zip(RESULTS, (LongType(), LongType(), StringType()), strict=True))])
    return shaped.mapInArrow(_dropper(uri, min_chars, out), schema).select(*(F.col(f"rest.`{c}`") for c in rest), *RESULTS)


def document_rows(numbered: DataFrame, min_chars: int) -> DataFrame:
    """(row, key): the distinct keys of each numbered document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, of = [], []
            for row, body in zip(part.column(0).to_pylist(), _texts(part, 1), strict=True):
                own = {k for k in line_keys(body, min_chars)[1] if k}
                keys += own
                of += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(keys, pa.binary())], ["row", "key"])

    return numbered.select("row", "text").mapInArrow(run, "row long, key binary")
