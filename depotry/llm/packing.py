"""Best-fit packing of token pieces into sequences by linear grouping.

The plan needs the histogram of piece lengths alone, at most ``max_tokens`` numbers whatever
the size of the corpus, so it is made on the driver:

1. pieces longer than a share of a sequence (``GROUPINGS``) are sorted and cut into groups of equal
   cardinality; each is rounded up to its group's largest length;
2. the few rounded sizes make a configuration program (column generation over patterns);
3. whole multiples of the patterns are kept and actual pieces take the slots of their group;
4. the parts of patterns that rounding down leaves over and all small pieces go in by best fit,
   longest first, beside what the patterns hold.

Bins stay run-length coded (a content and how many bins have it), so the work of the plan is
bounded too. Spark then ranks the pieces of each length and every rank has its slot.

Defined cases: null text is empty text and packs as the end id alone; an empty table gives no
rows; repeated rows are packed once each; pieces of equal length go by a hash of their ids, then by
their ids; texts of any length are cut, never dropped; extra
columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotry.llm.shared import Workspace, forget, once
from depotry.llm.textscan import text_buffers

#: Words of a generation that a worker remembers, and the bytes of the longest one.
WORDS_KEPT, LONGEST_KEPT = 220_000, 48
#: Words coded in one call, bytes of text coded together.
JOINED, BLOCK = 500, 1 << 19
#: A piece is large if its length times the first number is more than a sequence; the second is the number of groups.
#: Rounding up costs about half a group's span for each piece, so groups are many.
GROUPINGS = ((3, 400), (2.5, 400))
SLOT_COLUMNS = ["length", "low", "high", "shift", "offset"]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row_id long"


class WordCoder:
    """Ids of texts, coded by words between ASCII white space, which the tokenizer drops.

    A text's ids are its words' ids in order. Before the cut A-Z are lower-cased, as the tokenizer
    does, and a closing mark is set apart where a letter or digit stands before it and white space
    after, since a run of letters or digits never joins what follows. A bounded table of two
    generations remembers words; words of letters alone are coded many at a time, told apart by
    the mark that ends each of them. Texts that may hold special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer's own cost memory and switch for nothing.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _each(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _code(self, words: list[bytes]) -> dict[bytes, bytes]:
        coded, plain, rest = {}, [], []
        for w in words:
            (plain if w.isalpha() or w.decode().isalpha() else rest).append(w)
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            parts = [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if len(cuts) == len(some) else self._each(some)
            coded.update(zip(some, parts, strict=True))
        coded.update(zip(rest, self._each(rest), strict=True))
        return coded

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a column's buffers."""
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1))
            block, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if b"<|" in block.tobytes():
                for a, b in zip(at[:-1], at[1:], strict=True):
                    raw = block[a:b].tobytes()
                    yield self._each([raw])[0] if b"<|" in raw else self._texts(*_apart(block[a:b], np.array([0, b - a])))[0]
            else:
                yield from self._texts(*_apart(block, at))
            i = j

    def _texts(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        split = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if len(self.known) > WORDS_KEPT:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        back = {w: older[w] for w in new if w in older}
        known.update(back)
        coded = self._code([w for w in new if w not in back])
        known.update(coded)
        out = [b"".join([known[w] for w in ws]) for ws in split]
        for w in coded:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out


_MARK, _SPACE, _ALNUM = (np.isin(np.arange(256), list(b)) for b in (b".,!?;:", b" \t\n\x0b\x0c\r", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _apart(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank before closing marks, and the texts' offsets in them."""
    data = _LOWER[data]
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 1]
    after = np.append(data, 32)[mark + 1]
    one, two = data[mark - 1], data[mark - 2]
    # A letter of the Latin-1 block is C3 and a byte of 80 to BF; the two signs among them are none.
    letter = _ALNUM[one] | (two == 0xC3) & (one >= 0x80) & (one < 0xC0) & (one != 0x97) & (one != 0xB7)
    mark = mark[_SPACE[after] & letter]
    return np.insert(data, mark, 32), at + np.searchsorted(mark, at)


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every text plus ``end_id``; ``with_ids`` adds them as ``ids``.

    ``row_id`` is the same for all pieces of one row and differs between rows, repeated ones among them.
    """
    end, schema = np.array([end_id], "<u4").tobytes(), PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(f"coder {tokenizer}", lambda: WordCoder(tokenizer))
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids, columns = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), [[] for _ in range(7)]
            for (doc, row), coded in zip(ids, coder.blocks(data, offsets), strict=True):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * max_tokens)):
                    part = coded[at : at + 4 * max_tokens]
                    for c, v in zip(columns, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), row, np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "row_id", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 6 + with_ids], names[: 6 + with_ids])
        if with_ids:  # they go through a shuffle next, beside which the words of an idle worker take room
            forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row_id")).mapInArrow(run, schema)


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """(worth, pieces of each size) of the pattern worth most; sizes rise.

    ``upto[d]`` is the most that d pieces are worth by the room that they may take. The last two
    pieces of a pattern are only asked for at the rooms that are left for them.
    """
    depth, k = room // int(sizes[0]), len(sizes)
    upto, picks = [np.zeros(room + 1)], []
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")  # sizes that a room holds
    for _ in range(max(1, depth - 2)):
        value = np.zeros(room + 1)
        pick = np.full(room + 1, -1)
        if not picks:  # one piece: the best of those that fit
            best = np.maximum.accumulate(worth)
            first = np.maximum.accumulate(np.where(worth >= best, np.arange(k), 0))
            some = fits > 0
            value[some], pick[some] = best[fits[some] - 1], first[fits[some] - 1]
        else:
            for i, s in enumerate(sizes.tolist()):
                got = worth[i] + upto[-1][: room + 1 - s]
                better = got > value[s:] + 1e-12
                value[s:][better], pick[s:][better] = got[better], i
        pick[value <= 1e-12] = -1
        upto.append(np.maximum(value, 0))
        picks.append(pick)
    column, left = np.zeros(k), room
    for layer in range(depth, len(picks), -1):
        rest = left - sizes
        if layer == len(picks) + 2:  # what two more pieces are worth at each room that one leaves
            after = rest[:, None] - sizes[None, :]
            two = np.where(after >= 0, worth[None, :] + upto[-1][np.maximum(after, 0)], 0.0).max(1)
            value = np.where(rest >= 0, worth + np.maximum(two, 0), -1.0)
        else:
            value = np.where(rest >= 0, worth + upto[-1][np.maximum(rest, 0)], -1.0)
        i = int(value.argmax())
        if value[i] <= upto[-1][left] + 1e-12:
            continue
        column[i] += 1
        left -= int(sizes[i])
    for pick in reversed(picks):
        if (i := pick[left]) >= 0:
            column[i] += 1
            left -= int(sizes[i])
    return float(column @ worth), column


def _patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the configuration program's relaxation."""
    k = len(sizes)
    basis, cost = np.diag((room // sizes).astype(float)), np.ones(k)
    inverse = np.diag(1.0 / np.diag(basis))
    for _ in range(60 * k):
        worth = np.maximum(cost @ inverse, 0)
        value, column = _best_pattern(sizes, worth, room)
        if value <= 1 + 1e-7:
            break
        direction, x = inverse @ column, inverse @ demand
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return basis, np.maximum(inverse @ demand, 0)


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Take n items off a list of [length, count], longest first, as (length, count)."""
    got = []
    while n and runs:
        m = min(n, runs[-1][1])
        got.append((runs[-1][0], m))
        runs[-1][1] -= m
        n -= m
        if not runs[-1][1]:
            runs.pop()
    return got


def _configured(counts: np.ndarray, room: int, large: float, groups: int) -> list[tuple[int, tuple[int, ...]]]:
    """Steps 1 to 3; takes the pieces that it places out of ``counts``."""
    lengths = np.flatnonzero(counts)[::-1]
    lengths = lengths[lengths * large > room]
    total = int(counts[lengths].sum())
    if not total:
        return []
    groups = max(1, min(groups, total // 2))  # small tables have fewer groups, of two pieces at least
    sizes, members, demand, left = [], [], [], -(-total // groups)
    for length in map(int, lengths):
        n = int(counts[length])
        while n:
            if not demand or demand[-1] == left:
                sizes.append(length)
                members.append([])
                demand.append(0)
            m = min(n, left - demand[-1])
            members[-1].append([length, m])
            demand[-1] += m
            n -= m
    merged: dict[int, list] = {}  # a length with more pieces than a group has makes groups of one size
    for s, m, d in zip(sizes, members, demand, strict=True):
        merged.setdefault(s, [[], 0])
        merged[s][0] += m
        merged[s][1] += d
    sizes = np.array(sorted(merged))
    basis, used = _patterns(sizes, np.array([merged[int(s)][1] for s in sizes], float), room)
    runs = [merged[int(s)][0][::-1] for s in sizes]
    bins = []
    for column, times in zip(basis.T, np.floor(used + 1e-9).astype(int), strict=True):
        slots = [i for i in range(len(sizes)) for _ in range(int(round(column[i])))]
        whole = [min(times, sum(n for _, n in runs[i]) // max(1, slots.count(i))) for i in set(slots)]
        if not (times := min(whole, default=0)):
            continue
        filled = [_take(runs[i], times) for i in slots]
        while filled[0]:
            m = min(f[0][1] for f in filled)
            bins.append((m, tuple(f[0][0] for f in filled)))
            for f in filled:
                f[0] = (f[0][0], f[0][1] - m)
                if not f[0][1]:
                    f.pop(0)
    for m, content in bins:
        for length in content:
            counts[length] -= m
    return bins


def _best_fit(counts: np.ndarray, bins: list[tuple[int, tuple[int, ...]]], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """Step 4: all of ``counts``, longest first, each into the fullest bin that holds it."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(room + 1)]
    for m, content in bins:
        by_room[room - sum(content)].append((m, content))
    for length in map(int, np.flatnonzero(counts)[::-1]):
        n, gap = int(counts[length]), length
        while n:
            while gap <= room and not by_room[gap]:
                gap += 1
            if gap <= room:
                m, content = by_room[gap].pop()
                if m > n:
                    by_room[gap].append((m - n, content))
                    m = n
                by_room[gap - length].append((m, (*content, length)))
                n -= m
                gap = length if gap - length >= length else gap
            else:
                each = room // length
                if n >= each:
                    by_room[room - each * length].append((n // each, (length,) * each))
                    n %= each
                if n:
                    by_room[room - n * length].append((1, (length,) * n))
                    n = 0
    return [b for bins in by_room for b in bins]


def plan(counts: np.ndarray, room: int) -> tuple[list[tuple[int, tuple[int, ...]]], list[tuple[int, tuple[int, ...]]]]:
    """Bins (how many, lengths in each) for ``counts[length]`` pieces, and those of them that patterns made, before step 4.

    The better of GROUPINGS; all of them place their large pieces by patterns.
    """
    best = made = None
    least = -(-int((counts * np.arange(len(counts))).sum()) // room)
    for large, groups in GROUPINGS:
        left = counts.copy()
        patterns = _configured(left, room, large, groups)
        bins = _best_fit(left, patterns, room)
        if best is None or sum(m for m, _ in bins) < sum(m for m, _ in best):
            best, made = bins, patterns
        if sum(m for m, _ in best) == least:
            break
    return best, made


def plan_bins(counts: np.ndarray, room: int) -> list[tuple[int, tuple[int, ...]]]:
    """The bins of ``plan``."""
    return plan(counts, room)[0]


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece with its ``sequence_id`` and gapless ``offset``; see the module's text."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "packing")
    pieces = work.table(token_pieces(docs, tokenizer, max_tokens, end_id, with_ids), "pieces")
    counts = np.zeros(max_tokens + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most max_tokens rows
        counts[row["length"]] = row["count"]
    slots, base, ranks = [], 0, np.zeros(max_tokens + 1, np.int64)
    for m, content in plan_bins(counts, max_tokens):
        m, at = int(m), 0
        for length in content:
            low = int(ranks[length])
            slots.append((length, low, low + m, base - low, at))
            ranks[length] += m
            at += length
        base += m
    # An Arrow table goes to the JVM as it is; a list of rows would pass through plain Python workers, which stay beside the Arrow ones.
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in (zip(*slots, strict=True) if slots else [()] * len(SLOT_COLUMNS))], SLOT_COLUMNS))

    buckets = int(max(256, counts.sum() // 20_000))
    marked = pieces.drop("ids").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row_id"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row_id")
    ranked = marked.withColumn("nth", F.row_number().over(own)).join(sums, ["length", "bucket"]).withColumn("nth", F.col("before") + F.col("nth") - 1)
    # The slots are at most a few for each of max_tokens lengths and each planned run of bins: bounded, so broadcast.
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
    narrow = placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("nth") + F.col("shift")).alias("sequence_id"), "offset", "row_id")
    if not with_ids:
        return narrow
    # Places move as narrow rows; tokens move once, past a hash table of the places of their partition.
    return pieces.select("row_id", "piece", "ids").join(narrow.hint("shuffle_hash"), ["row_id", "piece"]).select(*narrow.columns, "ids")
