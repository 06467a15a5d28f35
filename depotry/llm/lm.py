"""Interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by workers.

Counting runs over every training document: words first (their place in the sorted hash arrays
is their id), then pairs of ids. The arrays lie in the shared folder and grow with the corpus;
workers map them and read only the pages they touch.

P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) * P1(w), with
P1(w) = max(a(w) - E(a(w)), 0) / A + h / (V + 1), a(w) the number of different words before w,
A their sum, three discounts D (from the numbers of pairs seen once to four times) and E (the
same of a), g and h what the discounts free. An unknown word gets h / (V + 1); after an
unknown word P1 is used. The sum over the V known tokens and one unknown is 1.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end for each text, which is
a token; a text begins after a start that is not.

Defined cases: null text is empty text and scores its end token; repeated rows count as often as
they stand there; with no training rows every score is 0; an empty table gives no rows; texts of
any length are read whole; extra columns are kept, but for the text and for ones named as results (in any case).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotry.llm.hashcount import PARTS_SCHEMA, SHARDS_A_TASK, Shards, merged, parts, write_shard
from depotry.llm.shared import Workspace, get_array, split_sorted, text_bytes
from depotry.llm.textscan import scan

END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text behind one shard of words and one of pairs.
WORD_SHARD, PAIR_SHARD = 32 << 20, 4 << 20
CONTEXT = np.dtype([("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
RESULTS = ("n_tokens", "n_known", "base_score", "score")


def _tokens(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, and where each text begins in them."""
    return np.insert(words, offsets[1:], END), offsets + np.arange(len(offsets))


def discounts(seen: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3 or more) from the numbers of things seen 1, 2, 3 and 4 times."""
    n = seen.astype(float)
    if not (n[:2] > 0).all():
        return np.array([0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.0]
    return np.clip(d, 0.0, [0, 1, 2, 3])


@dataclass
class Model:
    """Where the arrays lie and the few numbers that the driver holds."""

    folder: str
    word_shards: int
    pair_shards: int
    words: dict[int, int] = field(default_factory=dict)  # entries by shard
    pairs: dict[int, int] = field(default_factory=dict)
    wide: set[int] = field(default_factory=set)  # shards of pairs with counts that need 64 bits
    bases: np.ndarray | None = None  # first id of each shard of words
    vocabulary: int = 0
    tokens: int = 0
    distinct_pairs: int = 0
    pair_discounts: np.ndarray | None = None
    word_discounts: np.ndarray | None = None
    freed: float = 1.0  # h

    def ids(self, tokens: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Id of each token, -1 where unknown, and the token counts if asked for."""
        own, back = np.unique(tokens, return_inverse=True)
        ids, times = np.full(len(own), -1), np.zeros(len(own), np.uint64) if counts else None
        for shard, where, place, there in Shards(self.folder, self.words, self.word_shards, "word").find(own):
            ids[where] = np.where(there, self.bases[shard] + place, -1)
            if counts:
                times[where] = np.where(there, get_array(f"{self.folder}/times-{shard}.bin", "u8")[place], 0)
        return ids[back], times[back] if counts else None

    def first_ids(self) -> np.ndarray:
        """First id of each shard of pairs; the ids end with the start token's."""
        span = self.vocabulary + 1
        return np.array([-(-i * span // self.pair_shards) for i in range(self.pair_shards + 1)])

    def pair_cuts(self, keys: np.ndarray) -> np.ndarray:
        starts = self.first_ids()[1:-1].astype(np.uint64) << np.uint64(32)
        return np.concatenate(([0], np.searchsorted(keys, starts), [len(keys)]))

    def pair_counts(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each pair of known ids stands in the training texts."""
        out, known = np.zeros(len(ids), np.int64), np.flatnonzero((before >= 0) & (ids >= 0))
        keys, back = np.unique(before[known].astype(np.uint64) << np.uint64(32) | ids[known].astype(np.uint64), return_inverse=True)
        found, at = np.zeros(len(keys), np.int64), self.pair_cuts(keys)
        for shard in np.flatnonzero(np.diff(at)):
            if not self.pairs.get(int(shard)):
                continue
            where, mapped = slice(at[shard], at[shard + 1]), get_array(f"{self.folder}/pair-{shard}.bin", "u8")
            place = np.searchsorted(mapped, keys[where])
            place[place == len(mapped)] = 0
            found[where] = np.where(np.asarray(mapped[place]) == keys[where], get_array(f"{self.folder}/seen-{shard}.bin", "u8" if int(shard) in self.wide else "u4")[place], 0)
        out[known] = found[back]
        return out

    def by_id(self, ids: np.ndarray, name: str, kind: np.dtype) -> np.ndarray:
        """Values of a dense array cut by ``first_ids``."""
        out, starts = np.zeros(len(ids), kind), self.first_ids()
        own, back = np.unique(ids, return_inverse=True)
        values, at = np.zeros(len(own), kind), np.concatenate(([0], np.searchsorted(own, starts[1:-1]), [len(own)]))
        for shard in np.flatnonzero(np.diff(at)):
            where = slice(at[shard], at[shard + 1])
            if self.pairs.get(int(shard)) or name == "before":
                mapped = get_array(f"{self.folder}/{name}-{shard}.bin", kind.str if kind.names is None else kind)
                if len(mapped):
                    values[where] = mapped[own[where] - starts[shard]]
        out[:] = values[back]
        return out

    def probabilities(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """P(token | token before it); -1 is an unknown token."""
        p = np.full(len(ids), self.freed / (self.vocabulary + 1))
        known = np.flatnonzero(ids >= 0)
        a = self.by_id(ids[known], "before", np.dtype("<u4")).astype(np.int64)
        p[known] += np.maximum(a - self.word_discounts[np.minimum(a, 3)], 0) / max(1, self.distinct_pairs)
        after = np.flatnonzero(before >= 0)
        context, d = self.by_id(before[after], "context", CONTEXT), self.pair_discounts
        total = context["total"].astype(float)
        c = self.pair_counts(before[after], ids[after])
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = np.maximum(c - d[np.minimum(c, 3)], 0) / total
            freed = (d[1] * context["n1"] + d[2] * context["n2"] + d[3] * context["n3"]) / total
        p[after] = np.where(total > 0, kept + freed * p[after], p[after])
        return p


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count words, then pairs, of all rows of ``docs``."""
    work = Workspace(docs.sparkSession, "lm")
    folder, size = work.folder("arrays"), text_bytes(docs, text)
    model = Model(folder, max(4, size // WORD_SHARD), max(8, size // PAIR_SHARD))
    texts, word_shards = docs.select(F.col(text).cast("string").alias("text")), model.word_shards

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((_tokens(w, o)[0], None) for b in batches for _, w, o in scan(b.column(0)))
        return parts(pieces, lambda keys: split_sorted(keys, word_shards))

    def finish_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        write_shard(folder, shard, word=keys, times=counts)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)]), "total": pa.array([int(counts.sum())])})

    for r in merged(texts.mapInArrow(count_words, PARTS_SCHEMA), word_shards, finish_words, "shard int, n long, total long").collect():  # a row for each shard
        model.words[r["shard"]] = r["n"]
        model.tokens += r["total"]
    sizes = np.array([model.words.get(i, 0) for i in range(word_shards)])
    model.bases, model.vocabulary = np.concatenate(([0], np.cumsum(sizes)[:-1])), int(sizes.sum())
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2**32 different tokens: pairs of ids do not fit 64 bits")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, None]]:
            for b in batches:
                for _, w, o in scan(b.column(0)):
                    tokens, begin = _tokens(w, o)
                    ids = model.ids(tokens)[0]
                    before = np.roll(ids, 1)
                    before[begin[:-1]] = model.vocabulary
                    yield before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), None

        return parts(pieces(), model.pair_cuts)

    def finish_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = model.first_ids()
        v, w = (keys >> np.uint64(32)).astype(np.int64) - starts[shard], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        span = int(starts[shard + 1] - starts[shard])
        context = np.zeros(span, CONTEXT)
        for name, rows in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts > 2)):
            context[name] = np.bincount(v[rows], minlength=span)
        context["total"] = np.bincount(v, counts.astype(float), minlength=span).astype(np.uint64)
        wide = bool(len(counts)) and int(counts.max()) > 0xFFFFFFFF
        write_shard(folder, shard, pair=keys, seen=counts if wide else counts.astype(np.uint32), context=context)
        stats = [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), int(wide)]
        own, n = np.unique(w, return_counts=True)
        to = np.searchsorted(starts[1:-1], own.astype(np.int64), "right")
        columns = (pa.array(np.append(to, -1 - shard), pa.int64()), pa.array(np.append(own.astype(np.int64), 0)), pa.array(np.append(n, 0), pa.int64()), pa.array([None] * len(own) + [stats], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(list(columns), ["shard", "id", "n", "stats"])

    made = work.table(merged(texts.mapInArrow(count_pairs, PARTS_SCHEMA), model.pair_shards, finish_pairs, "shard long, id long, n long, stats array<long>"), "before")
    seen = np.zeros(4, np.int64)
    for r in made.where("shard < 0").select("shard", "stats").collect():  # a row for each shard
        model.pairs[-1 - r["shard"]] = r["stats"][0]
        model.distinct_pairs += r["stats"][0]
        seen += r["stats"][1:5]
        if r["stats"][5]:
            model.wide.add(-1 - r["shard"])
    model.pair_discounts = discounts(seen)

    def finish_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, shard, dense = model.first_ids(), -1, np.zeros(0, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            if shard >= 0:
                write_shard(folder, shard, before=dense.astype(np.uint32))
                counts = np.bincount(np.minimum(dense, 5), minlength=6)
                yield pa.RecordBatch.from_pydict({"n": pa.array([counts.tolist()], pa.list_(pa.int64()))})

        for batch in batches:
            of, ids, n = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
            for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[a] != shard:
                    yield from close()
                    shard = int(of[a])
                    dense = np.zeros(int(starts[shard + 1] - starts[shard]), np.int64)
                np.add.at(dense, ids[a:b] - starts[shard], n[a:b])
        yield from close()

    # A row for each id and shard of pairs that it stands in: as many as pairs at most, whatever the number of shards.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-model.pair_shards // SHARDS_A_TASK))
    cont = made.where("shard >= 0").select("shard", "id", "n").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(finish_before, "n array<long>")
    times = np.zeros(6, np.int64)
    for r in cont.collect():  # a row for each shard
        times += r["n"]
    work.remove("before")
    model.word_discounts = discounts(times[1:5])
    if model.distinct_pairs:
        model.freed = float((model.word_discounts[1:] * [times[1], times[2], times[3:].sum()]).sum() / model.distinct_pairs)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but for its text, with n_tokens, n_known, base_score and score (log10)."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *RESULTS)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_tokens long, n_known long, base_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.1 * (model.vocabulary + 1)
        for b in batches:
            made = []
            for _, w, o in scan(b.column(0)):
                tokens, begin = _tokens(w, o)
                ids, counts = model.ids(tokens, counts=True)
                before = np.roll(ids, 1)
                before[begin[:-1]] = model.vocabulary
                logs = np.log10(model.probabilities(before, ids))
                base = np.log10((counts.astype(float) + 0.1) / floor)
                made.append((np.diff(begin), *(np.add.reduceat(x, begin[:-1]) for x in ((ids >= 0).astype(np.int64), base, logs))))
            columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], [*b.schema.names[1:], *RESULTS])

    return docs.select(F.col(text).cast("string").alias("__text"), *(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
