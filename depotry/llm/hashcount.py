"""Counting 64-bit keys of a whole corpus into sorted arrays on the shared folder.

Tasks count what they see, cut the sorted keys into shards and send each shard's part as one
packed row: 8 bytes a key, and 4 more only for keys seen more than once. One task then merges a
shard into sorted arrays that workers memory-map. A shard's size is set by the number of shards,
which the caller takes from the bytes of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from depotry.llm.shared import forget, get_array, put_array, shard_starts

#: Keys that a task holds before it sends what it has.
HELD = 250_000
#: Shards that a merging task takes in turn, one in memory at a time.
SHARDS_A_TASK = 16
PARTS_SCHEMA = "shard int, once binary, more binary, times binary"
_PARTS = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("times", pa.binary())])


def summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts).astype(np.uint64)


def _pack(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return keys.tobytes() if width == 8 else np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, np.uint64)
    keys = np.zeros((len(raw) // width, 8), np.uint8)
    keys[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return keys.view(np.uint64).ravel()


def _cut(keys: np.ndarray, counts: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray], width: int) -> pa.RecordBatch:
    if len(counts) and int(counts.max()) > 0xFFFFFFFF:
        raise OverflowError("a task counted a key more than 2**32 times: its partition holds tens of GB")
    at, rows = cuts(keys), []
    for shard in np.flatnonzero(np.diff(at)):
        k, c = keys[at[shard] : at[shard + 1]], counts[at[shard] : at[shard + 1]]
        many = c > 1
        rows.append((int(shard), _pack(k[~many], width), _pack(k[many], width), c[many].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ((), (), (), ()), _PARTS, strict=True)], schema=_PARTS)


def parts(streams: Iterable[tuple[np.ndarray, np.ndarray | None]], cuts: Callable[[np.ndarray], np.ndarray], width: int = 8) -> Iterator[pa.RecordBatch]:
    """Packed parts of (keys, counts or None) pieces; ``cuts`` gives the shards' offsets in sorted keys of ``width`` bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    forget()
    for keys, counts in streams:
        held.append(summed(keys, counts))
        n += len(held[-1][0])
        if n > HELD:
            held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
            n = len(held[0][0])
            if n > HELD // 2:
                yield _cut(*held[0], cuts, width)
                held, n = [], 0
    if held:
        yield _cut(*summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])), cuts, width)


def merged(parts_df: DataFrame, shards: int, finish: Callable[[int, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]], schema: str, width: int = 8) -> DataFrame:
    """``finish(shard, keys, counts)`` once for each shard that has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces = -1, []

        def close() -> Iterable[pa.RecordBatch]:
            if shard < 0:
                return ()
            keys = np.concatenate([_unpack(b, width) for o, m, _ in pieces for b in (o, m)])
            counts = np.concatenate([x for o, _, t in pieces for x in (np.ones(len(o) // width, np.uint64), np.frombuffer(t, np.uint32).astype(np.uint64))])
            pieces.clear()
            return finish(shard, *summed(keys, counts))

        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                if number != shard:
                    yield from close()
                    shard = number
                pieces.append(tuple(batch.column(c)[row].as_py() for c in (1, 2, 3)))
        yield from close()

    tasks = max(parts_df.sparkSession.sparkContext.defaultParallelism, -(-shards // SHARDS_A_TASK))
    return parts_df.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


class Shards:
    """Lookup in sorted keys held by equal ranges of the space of 64 bits, less ``shift`` lower ones."""

    def __init__(self, folder: str, present: dict[int, int], shards: int, name: str = "keys", shift: int = 0):
        self.folder, self.present, self.shards, self.name, self.shift = folder, present, shards, name, shift

    def uri(self, shard: int, name: str = "") -> str:
        return f"{self.folder}/{name or self.name}-{shard}.bin"

    def find(self, sorted_keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """(shard, slice of the keys, place of each in the shard, which are there)."""
        at = np.concatenate(([0], np.searchsorted(sorted_keys, shard_starts(self.shards)[1:] >> np.uint64(self.shift)), [len(sorted_keys)]))
        for shard in np.flatnonzero(np.diff(at)):
            if not self.present.get(int(shard)):
                continue
            where, mapped = slice(int(at[shard]), int(at[shard + 1])), get_array(self.uri(int(shard)), "u8")
            place = np.searchsorted(mapped, sorted_keys[where])
            place[place == len(mapped)] = 0
            yield int(shard), where, place, np.asarray(mapped[place]) == sorted_keys[where]


def write_shard(folder: str, shard: int, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        put_array(f"{folder}/{name}-{shard}.bin", values)
