"""Exact top-k search by inner product with KD-trees over shards.

Vectors are scaled and floored to integers. Shards are regions of space: a tree that
splits the side of largest variance where the two parts vary least, fitted to SPLIT_SAMPLE vectors
of the smallest id hashes, deals every vector to a leaf, and a leaf with more than ``SHARD_ROWS`` (equal vectors, say) is dealt on by id hash. The
sample only shapes the regions; no result depends on it. Every shard holds its vectors in a KD-tree:
median splits of the widest side, tight bounding boxes, leaves of ``LEAF`` rows. A query goes
through a tree best-first: the bound of a box is the largest inner product that any point in it
could have, sum of max(q*low, q*high), and the walk ends when no open box reaches the query's k-th
best score. Queries go first to the shard of their own region; the k-th score found there travels
with the query, and it is sent on only to the shards whose whole box reaches that score.

A shard is one packed row and a block of queries another; a task streams a shard and then the
blocks sent to it, so it holds one of each. Boxes of shards come in pages of BOXES, and queries are
held against them in the same way. Equal vectors of a shard are one point with a list of ids,
smallest first, of which a query can use k + 1 at most.

Defined cases: a vector that is null, empty, or holds null or non-finite components takes no
part; vectors of different lengths are compared as if the shorter ended in zeros; a query skips
all rows of its own id; repeated rows are candidates of their own and a repeated query is
answered once for each; rows with a null id take no part; fewer than k candidates are all
returned; ties go to the smaller id; scores beyond 64 bits are held at the limit; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from depotry.llm.shared import Workspace

SHARD_ROWS, LEAF, BLOCK = 8192, 64, 256
#: Vectors that shape the regions, and the fewest of them in a leaf; boxes of shards in a page (1 kB each for 64 components).
SPLIT_SAMPLE, LEAF_SAMPLE, BOXES = 20_000, 8, 4096
_PACK = "group long, kind int, part long, dim int, ids binary, vectors binary, numbers binary, floors binary"
#: Sums of products up to here are exact in doubles.
_EXACT = float(1 << 52)


class Tree:
    """KD-tree over distinct integer vectors; ``ids[i]`` are the rows that have vector i, sorted."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if len(vectors) else np.zeros(0, np.int64)
        vectors, ids = vectors[order], ids[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))) if len(vectors) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.first, self.last = starts, np.append(starts[1:], len(ids))
        self.points, self.ids, self.k = vectors[starts], ids, k
        self.order = np.arange(len(starts))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left, right
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, len(starts), -1, 0)] if len(starts) else []
        while stack:
            a, b, parent, side = stack.pop()
            rows = self.points[self.order[a:b]]
            low, high = rows.min(0), rows.max(0)
            number = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            boxes.append((low, high))
            if parent >= 0:
                old = self.nodes[parent]
                self.nodes[parent] = (*old[:2], number, old[3]) if side == 0 else (*old[:3], number)
            if b - a > LEAF:
                axis, mid = int((high - low).argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
                stack += [(a, a + mid, number, 0), (a + mid, b, number, 1)]
        self.points = self.points[self.order]
        self.first, self.last = self.first[self.order], self.last[self.order]
        self.low = np.array([x for x, _ in boxes]).reshape(len(boxes), vectors.shape[1])
        self.high = np.array([x for _, x in boxes]).reshape(len(boxes), vectors.shape[1])

    def search(self, own: int, query: np.ndarray, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``floor``, best first."""
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        if not self.nodes:
            return best
        # All boxes' bounds in one go: two products with the query's positive and negative parts.
        bounds = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, at = heapq.heappop(open_)
            if -bound < floor or len(best) == self.k and -bound < best[0][0]:
                break
            a, b, left, right = self.nodes[at]
            if left >= 0:
                heapq.heappush(open_, (-bounds[left], left))
                heapq.heappush(open_, (-bounds[right], right))
                continue
            scores = self.points[a:b] @ query
            worst = best[0][0] if len(best) == self.k else floor
            for i in np.flatnonzero(scores >= worst):
                score = int(scores[i])
                used = 0
                for row in self.ids[self.first[a + i] : self.first[a + i] + min(self.last[a + i] - self.first[a + i], self.k + self._same(own, a + i))].tolist():
                    if row == own:
                        continue
                    entry = (score, -row)
                    if len(best) < self.k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
                    used += 1
                    if used == self.k:
                        break
        return [(s, -r) for s, r in sorted(best, reverse=True)]

    def _same(self, own: int, point: int) -> int:
        """Rows of the query's own id among a point's ids."""
        ids = self.ids[self.first[point] : self.last[point]]
        return int(np.searchsorted(ids, own, "right") - np.searchsorted(ids, own))


def _numbers(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


def _fitted(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Doubles where every sum of products is exact in them, else Python integers."""
    top = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    if top[0] * top[1] * max(1, arrays[0].shape[1]) < _EXACT:
        return list(arrays)
    return [np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) for a in arrays]


def integers(vector: str, scale: float) -> Column:
    """scale * x of each component as double, still to be floored; null for vectors that take no part."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    return F.when(sound, scaled)


def _row(names: tuple[str, ...], kinds: tuple[pa.DataType, ...], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], list(names))


_PACKED = ("group", "kind", "part", "dim", "ids", "vectors", "numbers", "floors")
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)


def _packed(rows: DataFrame, groups: int, size: int, kind: int) -> DataFrame:
    """Rows (group, id, v) packed: each group's vectors in parts of up to ``size`` rows; queries have a number and a floor, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        made: dict[int, int] = {}

        def close(group: int) -> pa.RecordBatch:
            some = held.pop(group)
            dim = max(len(v) for _, v, *_ in some)
            data = np.stack([np.pad(v, (0, dim - len(v))) for _, v, *_ in some])
            made[group] = made.get(group, -1) + 1
            rest = [np.array([r[i] for r in some], t).tobytes() if len(some[0]) > i else b"" for i, t in ((2, np.int64), (3, np.float64))]
            return _row(_PACKED, _KINDS, [(group, kind, made[group], dim, np.array([r[0] for r in some], np.int64).tobytes(), data.tobytes(), *rest)])

        for b in batches:
            more = [b.column(i).to_pylist() for i in range(3, b.num_columns)]
            for group, row, v, *rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), *more, strict=True):
                held.setdefault(group, []).append((row, np.floor(v.values.to_numpy(zero_copy_only=False)), *rest))
                if len(held[group]) == size:
                    yield close(group)
        for group in list(held):
            yield close(group)

    return rows.repartition(groups, "group").mapInArrow(run, _PACK)


class Regions:
    """Splits of the side of largest variance that set clusters apart, fitted to a sample; deals vectors of any length to leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]  # side, cut, left, right; a leaf's side is -1 and its number the third
        ready = [(-len(sample), 0, np.arange(len(sample)))]
        done = 0
        while ready and len(ready) + done < leaves:
            n, at, rows = heapq.heappop(ready)
            if -n < 2 * LEAF_SAMPLE or not sample.shape[1]:
                done += 1
                continue
            with np.errstate(all="ignore"):
                axis = int(np.nan_to_num(sample[rows].var(0)).argmax())
                v = np.sort(sample[rows, axis])
                upto, size = v.cumsum()[:-1], np.arange(1, len(v))
                apart = upto**2 / size + (v.sum() - upto) ** 2 / (len(v) - size)  # more means less variance within
            apart[(size < LEAF_SAMPLE) | (len(v) - size < LEAF_SAMPLE) | (v[1:] == v[:-1]) | ~np.isfinite(apart)] = -np.inf
            cut = float(v[1 + int(apart.argmax())])
            left = sample[rows, axis] < cut
            if not np.isfinite(apart.max()) or not left.any() or left.all():
                done += 1
                continue
            self.nodes[at] = (axis, cut, len(self.nodes), len(self.nodes) + 1)
            for part in (rows[left], rows[~left]):
                heapq.heappush(ready, (-len(part), len(self.nodes), part))
                self.nodes.append((-1, 0.0, 0, 0))
        self.leaves = 0
        for i, (axis, *_) in enumerate(self.nodes):
            if axis < 0:
                self.nodes[i] = (-1, 0.0, self.leaves, 0)
                self.leaves += 1
        self.side, self.left, self.right = (np.array([x[i] for x in self.nodes]) for i in (0, 2, 3))
        self.cut = np.array([x[1] for x in self.nodes])

    def deal(self, vectors: list[np.ndarray]) -> np.ndarray:
        dim = max([1, int(self.side.max()) + 1, *map(len, vectors)])
        x = np.stack([np.pad(np.floor(v), (0, dim - len(v))) for v in vectors]) if vectors else np.zeros((0, dim))
        at = np.zeros(len(x), np.int64)
        while (live := np.flatnonzero(self.side[at] >= 0)).size:
            here = at[live]
            at[live] = np.where(x[live, self.side[here]] < self.cut[here], self.left[here], self.right[here])
        return self.left[at]


def _dealt(rows: DataFrame, regions: Regions) -> DataFrame:
    """``rows(id, v, ..)`` with the leaf of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = regions.deal([v.values.to_numpy(zero_copy_only=False) for v in b.column(1)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], [*b.schema.names, "leaf"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("leaf", LongType())]))


def _boxes(shards: DataFrame, page: int) -> DataFrame:
    """Boxes of the shards' parts, up to ``page`` in a row: (page, dim, shards, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.select(["group", "dim", "vectors"]).to_pylist():
                x = _numbers(r["vectors"], r["dim"])
                rows.append((r["group"] // page, r["group"], r["dim"], x.min(0).tobytes(), x.max(0).tobytes()))
            yield _row(("page", "shard", "dim", "low", "high"), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), rows)

    return shards.mapInArrow(run, "page long, shard long, dim int, low binary, high binary")


def _routed(boxes: DataFrame, blocks: DataFrame, pages: int) -> DataFrame:
    """Blocks cut to the queries that a shard's box reaches, with that ``shard``; never the query's own shard, which is its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, built = -1, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["page"] != page:
                    page, held, built = r["page"], [], None
                if r["kind"] < 0:
                    held.append((r["shard"], np.frombuffer(r["low"]), np.frombuffer(r["high"])))
                    continue
                dim = max([r["dim"], *(len(low) for _, low, _ in held)])
                if built is None or built[0].shape[1] != dim:
                    # A shorter vector ends in zeros, so its box does.
                    built = tuple(np.stack([np.pad(x[i], (0, dim - len(x[i]))) for x in held]) for i in (1, 2))
                low, high = built
                q, floors = _fitted(_numbers(r["vectors"], r["dim"]), dim), np.frombuffer(r["floors"], np.float64)
                with np.errstate(all="ignore"):
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                    reach = ~(bound + slack < floors[:, None])
                rows = []
                ids, numbers = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["numbers"], np.int64)
                for shard, of in _by_shard([s for s, *_ in held], reach):
                    if shard != r["group"] and len(of):
                        rows.append((r["group"], 1, r["part"], dim, ids[of].tobytes(), np.ascontiguousarray(q[of]).tobytes(), numbers[of].tobytes(), floors[of].tobytes(), shard))
                yield _row((*_PACKED, "shard"), (*_KINDS, pa.int64()), rows)

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema.fields if f.name not in ("kind", "dim")]
    marked = boxes.select("page", F.lit(-1).alias("kind"), "dim", "shard", "low", "high", *none)
    asked = blocks.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))  # a page is BOXES shards
    both = marked.unionByName(asked, allowMissingColumns=True)
    return both.repartition(pages, "page").sortWithinPartitions("page", "kind").mapInArrow(run, _PACK + ", shard long")


def _by_shard(shards: list[int], reach: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Queries that any box of each shard reaches."""
    order = np.argsort(shards, kind="stable")
    names, first = np.unique(np.array(shards)[order], return_index=True)
    for name, a, b in zip(names.tolist(), first, [*first[1:], len(order)], strict=True):
        yield name, np.flatnonzero(reach[:, order[a:b]].any(1))


def _searched(shards: DataFrame, sent: DataFrame, groups: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score) of blocks of queries at the shards they are sent to; ``shard`` is a column of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[tuple[np.ndarray, np.ndarray]] = []
        shard, built = -1, None
        for b in batches:
            for row in b.to_pylist():
                if row["shard"] != shard:
                    shard, trees, built = row["shard"], [], None
                data, ids = _numbers(row["vectors"], row["dim"]), np.frombuffer(row["ids"], np.int64)
                if row["kind"] == 0:
                    trees.append((data, ids))
                    continue
                dim = max([row["dim"], *(t.shape[1] for t, _ in trees)])
                if built is None or built[0] != dim:
                    points = np.concatenate([_fitted(t, dim) for t, _ in trees]) if trees else np.zeros((0, dim))
                    built = (dim, points, Tree(points, np.concatenate([i for _, i in trees]) if trees else np.zeros(0, np.int64), k))
                queries, tree = _fitted(data, dim), built[2]
                exact = _exact(queries, built[1])
                if exact[0].dtype == object:
                    tree = copy.copy(tree)
                    tree.points, tree.low, tree.high = (np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (tree.points, tree.low, tree.high))
                numbers, floors = np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["floors"], np.float64)
                out: list[tuple[int, int, int, int]] = []
                for number, own, q, floor in zip(numbers.tolist(), ids.tolist(), exact[0], floors.tolist(), strict=True):
                    out += [(number, own, found, max(min(score, 2**63 - 1), -(2**63))) for score, found in tree.search(own, q, floor)]
                yield _row(("query", "query_id", "vec_id", "score"), (pa.int64(),) * 4, out)

    both = shards.withColumn("shard", F.col("group")).unionByName(sent)
    return both.repartition(groups, "shard").sortWithinPartitions("shard", "kind", "group", "part").mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries(id, v)`` against ``vectors(id, v)``."""
    work = Workspace(vectors.sparkSession, "knn")
    sound = lambda df: df.select(F.col("id").cast("long").alias("id"), integers("v", scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    points = work.table(sound(vectors), "points")
    groups = max(1, -(-points.count() // SHARD_ROWS))
    some = points.orderBy(F.xxhash64("id"), "id").limit(SPLIT_SAMPLE).select(F.lit(0).cast("long").alias("group"), "id", "v")
    sample = [_numbers(r["vectors"], r["dim"]) for r in (_packed(some, 1, SPLIT_SAMPLE, 0).collect() if groups > 1 else [])]  # one row, of a bounded sample
    regions = Regions(sample[0] if sample else np.zeros((0, 0)), groups)

    dealt = work.table(_dealt(points, regions), "dealt")
    counts = {r["leaf"]: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # SPLIT_SAMPLE / LEAF_SAMPLE leaves at most
    parts = np.array([max(1, -(-counts.get(i, 0) // SHARD_ROWS)) for i in range(regions.leaves)])
    groups, base = int(parts.sum()), np.concatenate(([0], np.cumsum(parts)[:-1]))
    leaves = F.broadcast(work.spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(base, parts, strict=True))], "leaf long, base long, parts long"))

    def grouped(df: DataFrame, *more: str) -> DataFrame:
        return df.join(leaves, "leaf").select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("group"), "id", "v", *more)

    shards = work.table(_packed(grouped(dealt), groups, SHARD_ROWS, 0), "shards")
    asked = work.table(_dealt(sound(queries).withColumn("number", F.monotonically_increasing_id()), regions), "queries")
    blocks = _packed(grouped(asked.withColumn("floor", F.lit(float("-inf"))), "number", "floor"), groups, BLOCK, 1)
    first = work.table(_best(_searched(shards, blocks.withColumn("shard", F.col("group")), groups, k), k), "first")
    if groups == 1:
        return first.select("query_id", "rank", "vec_id", "score")

    # A query's k-th score so far; a little less where doubles do not hold it, none where it was cut to 64 bits.
    low = F.min("score")
    kth = first.groupBy(F.col("query").alias("number")).agg(F.when((F.count(F.lit(1)) == k) & (low > F.lit(-(2**63))), low.cast("double") - F.abs(low.cast("double")) * F.when(F.abs(low) >= F.lit(1 << 53), 1e-15).otherwise(0.0)).alias("floor"))
    known = asked.join(kth, "number", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    bound = _packed(grouped(known, "number", "floor"), groups, BLOCK, 1)
    rest = work.table(_routed(_boxes(shards, BOXES), bound, -(-groups // BOXES)), "routed")
    return _best(first.drop("rank").unionByName(_searched(shards, rest, groups, k)), k).select("query_id", "rank", "vec_id", "score")
