"""Prefix trie of conversations: rolling fingerprints group candidates, turns verify them, sums roll up to parents.

A conversation is a sequence of (role, text) turns. Sequences are sorted and cut by range, whatever
the length of one, and numpy scans give every prefix a polynomial fingerprint: a task scans its
range, and what a conversation brought along from the ranges before (a row a range) is added after.
Prefixes of one depth and fingerprint are a candidate group, represented by its smallest
conversation. A group stands when in each member the last turn equals the representative's and the
prefix before belongs to one group; by induction over depth all turns are equal then. Groups that
fail are split by just these two. Turns are compared by the SHA-256 of role and text.

Sums over subtrees take as many steps as the longest conversation has binary digits: after step s
a node has the sum over its nearest 2**s levels and adds those of its descendants 2**s below. The
ancestor at any distance is the representative's own shorter prefix, so no step joins on a key that
many nodes share.

Defined cases: a null conversation id is no conversation and its rows are ignored; null roles and
texts count as empty; turns go by turn (null first), then role, then text, so repeated rows follow
one another; texts and conversations may have any length; other columns are ignored, whatever their
names; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.llm.shared import Workspace, join_by_key

#: Moduli of the two fingerprints and their base. Products of two residues fit 64 bits, sums of 2**32 of them too.
MODULI, BASE = (2147483629, 2147483587), 1000003
#: Ids that one list of a node's ends spans, so that no list has more.
SPAN = 1 << 16
#: Rows of a range, about.
RANGE_ROWS = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

_WORDS = r"[^\x20\x09-\x0D]+"


def _powers(n: int, modulus: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, BASE % modulus
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(modulus)
        have, step = have + more, step * step % modulus
    return out


def _scanned(batches: Iterator[pa.RecordBatch], moduli: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation with ``part``, their place in it (from 1) and the sums of turn * BASE**place, both counted within this task."""
    part, conv, place, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, turns = batch.column("conv_id").to_numpy(), batch.column("turn_hash").to_numpy().view(np.uint64)
        start = np.concatenate(([ids[0] != conv], ids[1:] != ids[:-1]))
        begin = np.where(start, np.arange(n), 0)
        np.maximum.accumulate(begin, out=begin)
        step = np.arange(n) - begin + 1
        goes_on = np.cumsum(start) == 0  # rows of the conversation that the batch before ended with
        at = step + np.where(goes_on, place, 0)
        columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int64))]
        for i, m in enumerate(moduli):
            term = turns % np.uint64(m) * _powers(n + 1, m)[step] % np.uint64(m)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
            own = (total[1:] - total[begin]) % np.uint64(m)
            own[goes_on] = (own[goes_on] * np.uint64(pow(BASE, place, m)) + np.uint64(sums[i])) % np.uint64(m)
            columns.append(pa.array(own.astype(np.int64)))
            sums[i] = int(own[-1])
        conv, place = ids[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place", "f0", "f1"])


def _carried(ends: list, moduli: tuple[int, int]) -> list[tuple]:
    """(part, conv_id, n, p0, f0, p1, f1): what the first conversation of a range brings from the ranges before."""
    out, conv, n, sums = [], None, 0, [0, 0]
    for e in sorted(ends, key=lambda e: e["part"]):
        if e["first"] != conv:
            n, sums = 0, [0, 0]
        else:
            out.append((e["part"], conv, n, *(x for s, m in zip(sums, moduli, strict=True) for x in (pow(BASE, n, m), s))))
        last = e["end"]
        if last["conv_id"] != e["first"]:
            n, sums = 0, [0, 0]
        sums = [(s + pow(BASE, n, m) * last[f"f{i}"]) % m for i, (s, m) in enumerate(zip(sums, moduli, strict=True))]
        conv, n = last["conv_id"], n + last["place"]
    return out


def prefix_scan(work: Workspace, rows: DataFrame, order: list[str], name: str, moduli: tuple[int, int] = MODULI, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (conv_id, turn_hash, ...) with ``place`` in the conversation by ``order`` (from 1) and the fingerprints ``f0``, ``f1`` of the prefix up to it.

    The columns of ``order`` drop out once rows are sorted. Ranges are cut within conversations
    too. The driver sees a row a range.
    """
    keys = [F.col("conv_id").asc(), *(F.col(c).asc_nulls_first() for c in order)]
    ranges = work.parts(rows.count(), range_rows)
    rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = work.table(rows.mapInArrow(lambda b: _scanned(b, moduli), f"{kinds}, part int, place long, f0 long, f1 long"), name)
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "f0", "f1")).alias("end")).collect()  # a row a range
    brought = rows.sparkSession.createDataFrame(_carried(ends, moduli), "part int, conv_id long, _n long, _p0 long, _f0 long, _p1 long, _f1 long")
    out = local.join(F.broadcast(brought), ["part", "conv_id"], "left")
    f = [F.coalesce((F.col(f"_f{i}") + F.col(f"_p{i}") * F.col(f"f{i}")) % m, F.col(f"f{i}")).alias(f"f{i}") for i, m in enumerate(moduli)]
    return out.select(*rows.columns, (F.col("place") + F.coalesce("_n", F.lit(0))).alias("place"), *f)


def with_hash(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, turn_hash, n_words); role and text not null. The digest is the SHA-256 of the role's length, the role and the text."""
    kept = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return kept.withColumn("digest", digest).withColumn("turn_hash", F.xxhash64("digest")).withColumn("n_words", F.regexp_count("text", F.lit(_WORDS)).cast("long"))


def shared_start(work: Workspace, turns: DataFrame, group: int = 20, most: int = 4, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share starts: (turns: conv_id, side, at, digest, turn_hash, n_words; ids: conv_id).

    The first h turns of conversation ``c`` become those of ``c - c % group``; h is the crc32 of the id's decimals
    modulo ``most``. A base passes at most ``most - 1`` turns to fewer than ``2 * group`` conversations.
    """
    placed = prefix_scan(work, with_hash(turns), ["turn", "role", "text"], "original", range_rows=range_rows)
    placed = work.table(placed.select("conv_id", (F.col("place") - 1).alias("at"), "digest", "turn_hash", "n_words"), "turns")
    ids = work.table(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id"), "ids")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = placed.where(F.col("at") >= h).select("conv_id", F.lit(1).alias("side"), "at", "digest", "turn_hash", "n_words")
    heads = placed.where((F.col("at") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "_base")
    taken = ids.select("conv_id", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % group).alias("_base")).where("_h > 0").join(heads, "_base").where("at < _h")
    return own.unionByName(taken.select("conv_id", F.lit(0).alias("side"), "at", "digest", "turn_hash", "n_words")), ids


def _with_group(work: Workspace, rows: DataFrame, key: Column, name: str) -> DataFrame:
    """``rows`` with the smallest conversation of their group as ``rep`` and its turn as ``rep_digest``."""
    keyed = rows.withColumn("key", key).drop("rep", "rep_digest")
    groups = work.table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("conv_id", "digest")).alias("_r")).select("key", "_n", F.col("_r.conv_id").alias("rep"), F.col("_r.digest").alias("rep_digest")), f"{name}-groups")
    return work.table(join_by_key(keyed, groups, "key", "_n").drop("key", "_n"), name)


def _with_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``before``: the group of the conversation's prefix that is a turn shorter (null at depth 1)."""
    shorter = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("before"))
    return rows.join(shorter, ["conv_id", "depth"], "left")


def prefix_groups(work: Workspace, rows: DataFrame, moduli: tuple[int, int] = MODULI, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, depth, rep, n_words): every prefix with the smallest conversation that has the same. Fingerprints propose, turns decide."""
    scanned = prefix_scan(work, rows, ["side", "at"], "rebuilt", moduli, range_rows).withColumnRenamed("place", "depth")
    narrow = scanned.select("conv_id", "depth", "digest", "n_words", "f0", "f1")
    found = _with_group(work, narrow, F.struct("depth", "f0", "f1"), "proposed").drop("f0", "f1")
    turn = 0
    while True:
        told = _with_before(found)
        failed = told.groupBy("depth", "rep").agg((F.min("before").eqNullSafe(F.max("before")) & F.bool_and(F.col("digest") == F.col("rep_digest"))).alias("ok")).where("NOT ok")
        if not failed.limit(1).count():
            return found
        turn += 1
        found = _with_group(work, told, F.struct("depth", "rep", F.coalesce("before", F.lit(0)).alias("before"), "digest"), f"split-{turn}").drop("before")


def _ends_digests(work: Workspace, ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of the lists of ids that end at a node, each list hashed piece by piece."""
    span = F.floor(F.col("conv_id") / SPAN)
    pieces = ends.withColumn("span", span).groupBy("rep", "depth", "span").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("said"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["rep", "depth", "ends_sha256"])
            done.clear()
            return out

        for batch in batches:
            for rep, depth, said in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "said")), strict=True):
                if (rep, depth) != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (rep, depth), hashlib.sha256(said.encode())
                else:
                    state.update(b"," + said.encode())
            if done:
                yield flush()
        if key:
            done.append((*key, state.hexdigest()))
            yield flush()

    return pieces.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "span").mapInArrow(hashed, "rep long, depth long, ends_sha256 string")


def build_trie(rows: DataFrame, ids: DataFrame, work: Workspace, moduli: tuple[int, int] = MODULI, range_rows: int = RANGE_ROWS) -> DataFrame:
    """NODE rows of the trie of the sequences in ``rows`` (conv_id, side, at, digest, turn_hash, n_words), one for each of ``ids``."""
    members = prefix_groups(work, rows, moduli, range_rows)
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).first()
    nodes = members.groupBy(F.col("rep").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"))
    root = rows.sparkSession.createDataFrame([(size["first"], 0, size["n"], 0)] if size["n"] else [], "conv_id long, depth long, n_convs long, n_words long")
    nodes = work.table(nodes.unionByName(root), "nodes")

    own = members.select("conv_id", "depth", "rep")

    def above(some: DataFrame, distance: int) -> DataFrame:
        """``some`` nodes with the representative ``up`` of their ancestor so many levels above."""
        deep = some.where(F.col("depth") > distance).withColumn("_d", F.col("depth") - distance)
        deep = deep.join(own.select("conv_id", F.col("depth").alias("_d"), F.col("rep").alias("up")), ["conv_id", "_d"]).drop("_d")
        return deep.unionByName(some.where(F.col("depth") == distance).withColumn("up", F.lit(size["first"]).cast("long")))

    parents = work.table(above(nodes, 1), "parents")
    children = parents.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    sums = work.table(valued.select("conv_id", "depth", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")), "sums-0")
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:
        below = above(sums.drop("n_children"), reach).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        more = sums.join(below, ["conv_id", "depth"], "left")
        sums = work.table(more.select("conv_id", "depth", "n_children", *((F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("n_leaves", "_l"), ("saved_tokens", "_s")))), f"sums-{reach}")
        reach *= 2

    last = members.groupBy("conv_id").agg(F.max(F.struct("depth", "rep")).alias("e")).select("conv_id", "e.depth", "e.rep")
    turnless = ids.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(size["first"]).cast("long").alias("rep"))
    ends = _ends_digests(work, last.unionByName(turnless)).withColumnRenamed("rep", "conv_id")
    out = nodes.join(sums, ["conv_id", "depth"]).join(parents.select("conv_id", "depth", F.col("up").alias("parent_conv_id")), ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, moduli: tuple[int, int] = MODULI, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The trie of conversations as they are: ``turns`` holds conv_id, turn, role and text."""
    work = Workspace(turns.sparkSession, "trie")
    rows = with_hash(turns)
    placed = prefix_scan(work, rows, ["turn", "role", "text"], "original", range_rows=range_rows)
    narrow = work.table(placed.select("conv_id", F.lit(1).alias("side"), F.col("place").alias("at"), "digest", "turn_hash", "n_words"), "turns")
    return build_trie(narrow, work.table(narrow.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id"), "ids"), work, moduli, range_rows)


def rebuilt_trie(turns: DataFrame, group: int = 20, most: int = 4, moduli: tuple[int, int] = MODULI, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The trie of conversations rebuilt by ``shared_start``."""
    work = Workspace(turns.sparkSession, "trie")
    rows, ids = shared_start(work, turns, group, most, range_rows)
    return build_trie(rows, ids, work, moduli, range_rows)
