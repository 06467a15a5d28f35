"""URL filter: host and path rules, and for the rest the ratio of two character models.

URLs that a rule allows or blocks teach two variable-order Markov models, of accepted and of
rejected URLs. A context of up to ``ORDER`` bytes counts where it was seen often enough; each order
is smoothed by the next shorter one with as much weight as the context has followers, the shortest
by the uniform distribution. A URL's score is the difference of the two log-likelihoods (base 2)
by symbol; the cutoff is the one that parts a held-out fifth of the ruled URLs best.

Counts are exact over all ruled URLs, then n-grams of a context that make up less than one in
``FINEST`` of all training symbols give way to shorter contexts. So at most ``FINEST`` n-grams of an
order remain, whatever the data, and the model that workers map has a proven bound (about 40 MB).

Defined cases: a null URL counts as empty; a URL without ``://`` has an empty host and path, fits no
rule and is judged by its whole text; URLs of any length are read whole; repeated rows count as often
as they occur; rules of equal length go by the longer host; equally good cutoffs take the one next to
0, then the smaller; if no ruled URL is of one kind, the verdict on the rest is the other kind (allow,
if there are none at all); extra columns stay, those that clash with result names give way; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotry.llm.shared import Workspace, get_array, once, put_array
from depotry.llm.textscan import text_buffers

#: Longest context in bytes; at least one in so many of the training symbols keeps an n-gram.
ORDER, FINEST = 5, 1 << 17
#: Marks before and after a URL; symbols there are.
START, END, SYMBOLS = 2, 3, 257
#: Positions scored at once; distinct n-grams that a task holds.
CHUNK, HELD = 1 << 17, 500_000
#: Cutoffs tried: steps of 1 / FINE from -WIDEST to WIDEST bits a symbol.
FINE, WIDEST = 64, 16
#: Rules are literals of the plan.
MOST_RULES = 1000
RESULTS = ("host", "path", "rule", "verdict", "score")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _text(url: Column) -> Column:
    """What the models read: the URL behind its scheme, A-Z lower-cased."""
    return F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), _UPPER, _LOWER)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. A rule is ``host/path``; it fits its host and all subdomains."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        if said not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a rule: {said} {text}")
        at, below = text.split("/", 1)
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, positions to predict): every text between ORDER start marks and an end mark."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    begin = np.concatenate(([0], np.cumsum(lens + ORDER + 1)))[:-1]
    out = np.full(int(lens.sum()) + n * (ORDER + 1), START, np.uint8)
    row = np.repeat(np.arange(n), lens)
    out[begin[row] + ORDER + np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]] = data[offsets[0] : offsets[-1]]
    out[begin + ORDER + lens] = END
    inner = np.ones(len(out), bool)
    inner[(begin[:, None] + np.arange(ORDER)).ravel()] = False
    return out, np.flatnonzero(inner)


def _keys(symbols: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of order 0, 1, .. at these positions: the order, the context's bytes, the symbol."""
    packed = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        packed |= symbols[at - k].astype(np.uint64) << np.uint64(8 * k)
        yield packed | np.uint64(k << 56)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(key, n_allow, n_block) over (blocked int, text): counted by task before they are shuffled."""
    kinds = pa.schema([("key", pa.int64()), ("n_allow", pa.int64()), ("n_block", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, *(np.bincount(of, np.concatenate([h[i] for h in held]), len(keys)).astype(np.int64) for i in (1, 2))

        def sent() -> pa.RecordBatch:
            keys, allow, block = summed()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(allow), pa.array(block)], schema=kinds)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            blocked = batch.column(0).to_numpy().astype(np.int64)
            symbols, at = _symbols(data, offsets)
            of_row = np.repeat(blocked, np.diff(offsets) + 1)
            for i in range(0, len(at), CHUNK):
                some, kind = at[i : i + CHUNK], of_row[i : i + CHUNK]
                for keys in _keys(symbols, some):
                    held.append((keys, 1 - kind, kind))
                held[:] = [summed()]
                if len(held[0][0]) > HELD:
                    yield sent()
        if held:
            yield sent()

    return labelled.mapInArrow(count, "key long, n_allow long, n_block long").groupBy("key").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))


@dataclass(frozen=True)
class Model:
    """Where the sorted arrays lie, and the cutoff; without a folder the verdict is fixed."""

    folder: str | None
    cutoff: float
    fixed: str = "allow"


def _store(work: Workspace, counts: DataFrame, finest: int) -> str:
    """Write the arrays of the n-grams that stay, and of their contexts."""
    total = counts.where("shiftright(key, 56) = 0").agg(F.sum(F.col("n_allow") + F.col("n_block"))).first()[0] or 0
    kept = counts.where(F.col("n_allow") + F.col("n_block") >= max(1, total / finest)).toPandas()  # finest rows an order at most
    kept = kept.sort_values("key")
    keys, counted = kept["key"].to_numpy().astype(np.uint64), kept[["n_allow", "n_block"]].to_numpy(np.int64)
    contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
    sums = np.add.reduceat(counted, first, axis=0) if len(first) else counted
    followers = np.add.reduceat((counted > 0).astype(np.int64), first, axis=0) if len(first) else counted
    folder = work.folder("model")
    for name, values in (("keys", keys), ("counts", counted), ("contexts", contexts), ("sums", sums), ("followers", followers)):
        put_array(f"{folder}/{name}.bin", values)
    return folder


def _log_ratio(model: tuple[np.ndarray, ...], symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log2 of accepted over rejected likelihood at each position."""
    keys, counts, contexts, sums, followers = model
    p = np.full((len(at), 2), 1 / SYMBOLS)
    for key in _keys(symbols, at):
        n, total, kinds = (_found(where, values, wanted) for where, values, wanted in ((keys, counts, key), (contexts, sums, key >> np.uint64(8)), (contexts, followers, key >> np.uint64(8))))
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log2(p[:, 0]) - np.log2(p[:, 1])


def _found(where: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(where):
        return np.zeros((len(wanted), 2))
    place = np.minimum(np.searchsorted(where, wanted), len(where) - 1)
    return np.where((where[place] == wanted)[:, None], values[place], 0)


def _load(folder: str) -> tuple[np.ndarray, ...]:
    def of(name: str, kind: str) -> np.ndarray:
        return get_array(f"{folder}/{name}.bin", kind)

    return of("keys", "u8"), of("counts", "i8").reshape(-1, 2), of("contexts", "u8"), of("sums", "i8").reshape(-1, 2), of("followers", "i8").reshape(-1, 2)


def score_column(text: Column, folder: str) -> Column:
    """Length-normalised log-likelihood difference of the texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = once(f"urls {folder}", lambda: _load(folder))
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        symbols, at = _symbols(data, offsets)
        n = np.diff(offsets) + 1
        row, out = np.repeat(np.arange(len(n)), n), np.zeros(len(n))
        for i in range(0, len(at), CHUNK):
            out += np.bincount(row[i : i + CHUNK], _log_ratio(model, symbols, at[i : i + CHUNK]), len(n))
        return pd.Series(out / n)

    return score(text)


def _cutoff(bins: list, fine: int) -> float:
    """The bin edge with the least sum of the two kinds' error rates; (bin, allowed, blocked) rows."""
    allowed, blocked = sum(b["allowed"] for b in bins), sum(b["blocked"] for b in bins)
    if not allowed or not blocked:
        return 0.0
    below = {b["bin"]: (b["allowed"], b["blocked"]) for b in bins}
    wrong, lost, best = 1.0, 0.0, []  # at the lowest edge all are allowed
    for edge in range(-WIDEST * fine, WIDEST * fine + 2):
        best.append((round(wrong + lost, 12), abs(edge), edge))
        a, b = below.get(edge, (0, 0))
        lost, wrong = lost + a / allowed, wrong - b / blocked
    return min(best)[2] / fine


def fit(urls: DataFrame, rules: list[tuple[str, str]], finest: int = FINEST) -> Model:
    """Models and cutoff from the ``url`` column of ``urls`` and the rules."""
    work = Workspace(urls.sparkSession, "urls")
    rule, verdict = matched_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    text = _text(F.col("url"))
    ruled = urls.select(verdict.alias("verdict"), text.alias("text")).where("verdict IS NOT NULL").select((F.col("verdict") == "block").cast("int").alias("blocked"), "text")
    ruled = ruled.withColumn("held", F.crc32(F.col("text").cast("binary")) % 5 == 0)
    kinds = {r["blocked"] for r in ruled.where("NOT held").groupBy("blocked").count().collect()}
    if kinds != {0, 1}:
        return Model(None, 0.0, "block" if kinds == {1} else "allow")
    folder = _store(work, work.table(count_ngrams(ruled.where("NOT held").select("blocked", "text")), "counts"), finest)
    near = F.greatest(F.lit(-WIDEST * FINE), F.least(F.lit(WIDEST * FINE), F.floor(score_column(F.col("text"), folder) * FINE)))
    held = ruled.where("held").select("blocked", near.cast("int").alias("bin")).groupBy("bin").agg(F.sum(1 - F.col("blocked")).alias("allowed"), F.sum("blocked").alias("blocked"))
    return Model(folder, _cutoff(held.collect(), FINE))  # a row a bin


def judge(urls: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """``urls`` with host, path, rule, verdict (the rule's, else the model's) and score."""
    kept = urls.select(*(c for c in urls.columns if c.lower() not in RESULTS))
    out = kept.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    score = score_column(_text(F.col("url")), model.folder) if model.folder else F.lit(None).cast("double")
    out = out.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("score", score)
    judged = F.when(F.col("score") >= model.cutoff, F.lit("allow")).otherwise(F.lit("block")) if model.folder else F.lit(model.fixed)
    return out.withColumn("verdict", F.coalesce("verdict", judged))


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], finest: int = FINEST) -> DataFrame:
    """``judge`` by the models of the same URLs."""
    return judge(urls, rules, fit(urls, rules, finest))
