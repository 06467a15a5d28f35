"""Phrase collocations: merged count-min sketches, exact counts of what survives them, scores, subsumption.

First pass: every task maps the 1- to 5-grams of its texts to cells of a count-min sketch (``DEPTH``
rows) and sends the cells, sorted and as compressed gaps, to their blocks; a block of ``BLOCK`` cells
adds up what all tasks send it and keeps a bit a cell: whether it holds the least count. The number
of cells follows the bytes of text, so a sketch is as crowded on a large corpus as on a small one, no
task holds a sketch, and what a block adds up does not grow. A merged cell never shows less than the
true count. Second pass: n-grams that the sketch lets through, and whose parts it lets through, are
counted exactly by their 64-bit hash, in shards; whatever is frequent is among them. Third pass:
every frequent n-gram is spelt by one of the tasks that saw it, so words move once a phrase and not
once a task. (Two n-grams of one hash would count as one: with ten million that pass the sketch, a
chance of three in a million.)

Defined cases: null text counts as empty text, a null language as ``und``; texts of any length are
read whole, in segments; repeated rows count as often as they occur; equal scores go by count, then
by the bytes of the phrase; equal lowest cuts take the first; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotry.llm.shared import Workspace, forget, get_array, put_array, split_sorted, text_bytes
from depotry.llm.textscan import hash_words, mix64, segments, text_buffers

#: Rows of a sketch, cells in a row as a power of two (at least and at most), bytes of text to a cell, cells in a block.
DEPTH, WIDTH, WIDEST, CELL_BYTES, BLOCK = 2, 24, 32, 64, 1 << 20
#: Parts of a block that are added at once, and cells in them (about).
FAN_IN, ADDED = 64, 1 << 21
#: Words that a task works on at once; n-grams that it holds before it sends them; bytes of text that a task reads, at least, and that make a shard of the counts.
HELD_WORDS, HELD_NGRAMS, TASK_BYTES, SHARD_BYTES = 1 << 19, 2_000_000, 64 << 20, 16 << 20
#: Shares of a language that are ranked on their own before the best of each are ranked together.
SHARES = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = pa.schema([("block", pa.int32()), ("gaps", pa.binary())])
_PARTS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
_FREQUENT = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("f", pa.int64())])
_SPELT = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("words", pa.int64())])


@dataclass
class Words:
    """Consecutive words: ids into ``distinct``, the piece and language of each. The first ``old`` ones only give context."""

    ids: np.ndarray
    distinct: pa.Array
    piece: np.ndarray
    lang: np.ndarray
    langs: list[str]
    old: int


def word_runs(batches: Iterator[pa.RecordBatch], longest: int, held_words: int = HELD_WORDS) -> Iterator[Words]:
    """The words of (lang, text) rows in order; each run repeats the last words of the one before, so that no n-gram is lost between them."""
    codes: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = pieces = old = 0

    def run() -> tuple[Words, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        data, lens, piece, lang = (np.concatenate(x) for x in zip(*held, strict=True))
        offsets = np.concatenate(([0], np.cumsum(lens)))
        coded = pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        keep = min(longest - 1, len(lens))
        tail = (data[offsets[-1 - keep] :], lens[len(lens) - keep :], piece[len(lens) - keep :], lang[len(lens) - keep :])
        return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, piece, lang, list(codes), old), tail

    for batch in batches:
        spoken = [codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()]
        data, at = text_buffers(batch.column(1))
        for i, j, a, b in segments(at, data):
            part = data[a:b]
            inside = _INSIDE[part]
            opens = (at[i:j] - a)[(at[i:j] >= a) & (at[i:j] < b)]  # where texts begin; none where a long one goes on
            marks = _BREAK[part].astype(np.int64)
            np.add.at(marks, opens, 1)
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[opens] = inside[opens]
            edge = opens[opens > 0]
            last[edge - 1] = inside[edge - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(starts):
                row = np.searchsorted(at, a + starts, "right") - 1
                held.append((_LOWER[part[inside]], ends - starts, pieces + np.cumsum(marks)[starts], np.array(spoken, np.int64)[row]))
                size += len(starts)
            pieces += int(marks.sum())
            if size >= held_words:
                words, tail = run()
                yield words
                held, size, old = [tail], 0, len(tail[1])
    if size:
        yield run()[0]


def _ngrams(words: Words, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of the n-grams that lie within a piece, for n = 1, 2, ...; send back which starts go on (or None for all)."""
    data, at = text_buffers(words.distinct)
    of_word = hash_words(data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0], fold=False)[words.ids]
    tongue = np.array([xxhash.xxh64_intdigest(x.encode()) for x in words.langs], np.uint64)[words.lang]
    starts, hashes = np.arange(len(words.ids)), mix64(of_word ^ tongue)
    for n in range(1, longest + 1):
        going = yield n, starts, hashes
        if going is not None:
            starts, hashes = starts[going], hashes[going]
        fits = starts + n < len(words.ids)
        fits[fits] = words.piece[starts[fits] + n] == words.piece[starts[fits]]
        starts, hashes = starts[fits], hashes[fits]
        hashes = mix64(hashes * _BASE ^ of_word[starts + n])


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes >> np.uint64(64 - width * (row + 1))) & np.uint64((1 << width) - 1)).astype(np.uint32)


def add_to(sketch: np.ndarray, hashes: np.ndarray, width: int) -> None:
    """Count the hashes; a cell stops at the most that it holds."""
    most = np.iinfo(sketch.dtype).max
    for row in range(len(sketch)):
        cells = np.sort(_cells(hashes, row, width))
        edge = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
        seen, times = cells[edge], np.diff(np.append(edge, len(cells)))
        sketch[row, seen] = np.minimum(sketch[row, seen] + times, most).astype(sketch.dtype)


def estimate(sketch: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    return np.min([sketch[row, _cells(hashes, row, width)] for row in range(len(sketch))], axis=0)


def sketch_width(text: int) -> int:
    """Cells in a row, as a power of two, for so many bytes of text."""
    return min(WIDEST, max(WIDTH, (text // CELL_BYTES).bit_length()))


def _blocks(width: int) -> int:
    return max(1, (1 << width) // BLOCK)


def _pressed(cells: np.ndarray) -> bytes:
    """Gaps of sorted cells, byte by byte: most are small, so the higher bytes take nearly no place."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpressed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def sketch_corpus(work: Workspace, docs: DataFrame, longest: int, min_count: int, width: int) -> str:
    """Folder of the merged sketch: a file of bits for each row, set where a cell holds ``min_count`` or more."""
    folder, blocks = work.folder("sketch"), _blocks(width)
    size = (1 << width) // blocks

    def sent(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            cells = np.sort(_cells(hashes, row, width))
            at = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(size))
            numbers = np.flatnonzero(np.diff(at))
            gaps = [_pressed(cells[at[b] : at[b + 1]] - np.uint32(b * size)) for b in numbers.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(numbers + row * blocks, pa.int32()), pa.array(gaps, pa.binary())], schema=_BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []
        for words in word_runs(batches, longest):
            held += [h[s + n > words.old] for n, s, h in _ngrams(words, longest)]
            if sum(map(len, held)) >= HELD_NGRAMS:
                hashes, held = np.concatenate(held), []
                yield from sent(hashes)
        if held:
            yield from sent(np.concatenate(held))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Sums of the rows of one block, which lie side by side."""
        key, total, held = None, np.zeros(size, np.int64), []
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column(0)[row].as_py()
                if held and (block != key or len(held) == FAN_IN or sum(map(len, held)) >= ADDED):
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held = []
                if block != key:
                    if key is not None:
                        yield key, total
                    key, total = block, np.zeros(size, np.int64)
                held.append(_unpressed(batch.column(1)[row].as_py()))
        if key is not None:
            yield key, total + np.bincount(np.concatenate(held), minlength=size)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in added(batches):
            put_array(f"{folder}/block-{block}.bin", np.packbits(total >= min_count, bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["block"])

    moved = docs.mapInArrow(count, "block int, gaps binary").repartition(work.parts(DEPTH * blocks, 16), "block").sortWithinPartitions("block")
    present = {r["block"] for r in moved.mapInArrow(store, "block int").collect()}  # DEPTH * blocks at most

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                bits = [np.asarray(get_array(f"{folder}/block-{b}.bin", "u1")) if b in present else np.zeros(-(-size // 8), np.uint8) for b in range(row * blocks, (row + 1) * blocks)]
                put_array(f"{folder}/row-{row}.bin", np.concatenate(bits))
            yield batch

    docs.sparkSession.range(0, DEPTH, 1, DEPTH).mapInArrow(join, "id long").collect()  # DEPTH rows
    return folder


def _passing(words: Words, folder: str, longest: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of the n-grams that the sketch lets through and whose parts it lets through."""
    rows = [np.asarray(get_array(f"{folder}/row-{row}.bin", "u1")) for row in range(DEPTH)]
    alive = np.ones(len(words.ids) + 1, bool)  # starts whose (n-1)-gram may be frequent
    walk, going = _ngrams(words, longest), None
    while True:
        try:
            n, starts, hashes = walk.send(going)
        except StopIteration:
            return
        going = alive[starts] & (alive[starts + 1] if n > 1 else True)
        for row, bits in enumerate(rows):
            cells = _cells(hashes[going], row, width)
            going[going] = (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1
        alive = np.zeros(len(words.ids) + 1, bool)
        alive[starts[going]] = True
        yield n, starts[going], hashes[going]


def frequent_hashes(work: Workspace, docs: DataFrame, folder: str, longest: int, min_count: int, width: int, shards: int) -> DataFrame:
    """(part, key, f) of the n-grams with f >= min_count; ``part`` is a partition of ``docs`` that holds one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            at = split_sorted(keys, shards)
            there = np.flatnonzero(np.diff(at)).tolist()
            pieces = [[x[at[i] : at[i + 1]].tobytes() for i in there] for x in (keys, times.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([part] * len(there), pa.int32()), *(pa.array(x, pa.binary()) for x in pieces)], schema=_PARTS)

        for words in word_runs(batches, longest):
            held += [h[s + n > words.old] for n, s, h in _passing(words, folder, longest, width)]
            if sum(map(len, held)) >= HELD_NGRAMS:
                yield sent()
        if held:
            yield sent()

    def tally(pieces: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys, times = (np.concatenate([np.frombuffer(p[i], t) for p in pieces]) for i, t in ((1, np.uint64), (2, np.uint32)))
        parts = np.repeat(np.array([p[0] for p in pieces], np.int32), [len(p[1]) // 8 for p in pieces])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        f = np.add.reduceat(times[order].astype(np.int64), first)
        many = np.flatnonzero(f >= min_count)
        held = np.diff(np.append(first, len(keys)))[many]
        keys = keys[first[many]]
        one = parts[order[first[many] + (keys % held.astype(np.uint64)).astype(np.int64)]]  # any of them, so that all tasks spell about as many
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(keys.view(np.int64), pa.int64()), pa.array(f[many], pa.int64())], schema=_FREQUENT)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                number, *piece = (batch.column(c)[row].as_py() for c in range(4))
                if pieces and number != shard:
                    yield tally(pieces)
                    pieces = []
                shard = number
                pieces.append(piece)
        if pieces:
            yield tally(pieces)

    moved = docs.mapInArrow(count, "shard int, part int, keys binary, times binary")
    moved = moved.repartition(work.parts(shards, 1), "shard").sortWithinPartitions("shard")
    return work.table(moved.mapInArrow(merge, "part int, key long, f long"), "frequent")


def spelt(work: Workspace, docs: DataFrame, folder: str, frequent: DataFrame, longest: int, width: int) -> DataFrame:
    """(key, lang, n_words, phrase) of the frequent n-grams, each from its part of ``docs``; and (lang, words) of every part, with n_words 0."""
    own = work.folder("own")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            parts, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for at in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if held and parts[at[0]] != part:
                    yield kept(part, held)
                    held = []
                part = int(parts[at[0]])
                held.append(keys[at])
        if held:
            yield kept(part, held)

    def kept(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        put_array(f"{own}/{part}.bin", np.sort(np.concatenate(held).view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    dealt = frequent.select("part", "key").repartition("part").sortWithinPartitions("part")
    present = {r["part"] for r in dealt.mapInArrow(deal, "part int").collect()}  # a number for each partition of docs

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys = np.array(get_array(f"{own}/{part}.bin", "u8")) if part in present else np.zeros(0, np.uint64)
        open_ = np.ones(len(keys), bool)
        for words in word_runs(batches, longest):
            names = np.asarray(words.distinct.to_numpy(zero_copy_only=False), object)
            total = np.bincount(words.lang[words.old :], minlength=len(words.langs)).tolist()
            rows = [(None, lang, 0, None, seen) for lang, seen in zip(words.langs, total, strict=True) if seen]
            for n, starts, hashes in _passing(words, folder, longest, width) if open_.any() else ():
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                mine = np.flatnonzero((keys[at] == hashes) & open_[at])
                places, first = np.unique(at[mine], return_index=True)
                open_[places] = False
                at = starts[mine[first]]
                rows += [(key, words.langs[lang], n, " ".join(p), None) for key, lang, p in zip(keys[places].view(np.int64).tolist(), words.lang[at].tolist(), names[words.ids[at[:, None] + np.arange(n)]].tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPELT, strict=True)], schema=_SPELT)
        forget()

    return work.table(docs.mapInArrow(spell, "key long, lang string, n_words int, phrase string, words long"), "spelt")


def count_ngrams(docs: DataFrame, longest: int = 5, min_count: int = 100, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, n_words, phrase, f) of every n-gram with f >= min_count, (lang, n) of all words); both written."""
    work = Workspace(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = text_bytes(texts)
    width = width or sketch_width(size)
    texts = texts.coalesce(work.parts(size, TASK_BYTES))
    folder = sketch_corpus(work, texts, longest, min_count, width)
    frequent = frequent_hashes(work, texts, folder, longest, min_count, width, 1 + size // SHARD_BYTES)
    names = spelt(work, texts, folder, frequent, longest, width)
    kept = work.table(names.where("n_words > 0").join(frequent, "key").select("lang", "n_words", "phrase", "f"), "counts")
    if kept.count() != frequent.count():
        raise RuntimeError("texts differ between passes: write them first")
    return kept, work.table(names.where("n_words = 0").groupBy("lang").agg(F.sum("words").alias("n")), "totals", 1)


def score_phrases(frequent: DataFrame, totals: DataFrame, subsume_pct: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one covers.

    The lowest score of all cuts counts, worked out in decimals of 38 digits. Joins are by
    (language, phrase); where one part starts many phrases, Spark's adaptive joins split its rows.
    """
    phrases = frequent.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    part = frequent.select("lang", F.col("phrase").alias("_p"), "f")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cut = cut.withColumn("_first", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ")).withColumn("_rest", F.array_join(F.slice("_w", F.col("k") + 1, F.col("n_words")), " "))
    cut = cut.join(part.withColumnsRenamed({"_p": "_first", "f": "l"}), ["lang", "_first"]).join(part.withColumnsRenamed({"_p": "_rest", "f": "r"}), ["lang", "_rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))

    begin = F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))
    inner = phrases.where("n_words > 2").withColumn("_i", begin).withColumn("_m", F.explode(F.sequence(F.lit(2), F.least(F.col("n_words") - 1, F.col("n_words") - F.col("_i") + 1))))
    covers = inner.groupBy("lang", F.array_join(F.slice("_w", F.col("_i"), F.col("_m")), " ").alias("phrase")).agg(F.max("a").alias("_longer"))
    left = scored.join(covers, ["lang", "phrase"], "left").where(f"_longer IS NULL OR 100 * _longer < {int(subsume_pct)} * a")
    return left.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def mine_phrases(docs: DataFrame, longest: int = 5, min_count: int = 100, top: int = 2000, subsume_pct: int = 100, width: int | None = None) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: (lang, rank, phrase, a, l, r, n, score).

    ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring cut, ``n`` all words
    of the language; the score is floor(1000 a n / (l r)). ``width`` is that of the sketch (see ``sketch_width``).
    """
    scored = score_phrases(*count_ngrams(docs, longest, min_count, width), subsume_pct)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    near = scored.withColumn("_s", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*best))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
