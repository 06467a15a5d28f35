"""Quality rules: plain limits, then robust multivariate outliers by language and source.

The outlier rule fits a minimum-covariance-determinant estimate for every group of rows and
rejects a row whose transformed statistic vector lies too far from it by Mahalanobis distance.

The estimate is the deterministic form of the method, run over all rows. A group has several
starts (STARTS), each from medians and quartiles: the scaled statistics taken as independent, the
covariance of their signs in space, and the correlation of their hyperbolic tangents. From every
start concentration steps follow, each of which keeps the ``KEEP`` share of a group's rows that
lie nearest and takes their mean and covariance, until the determinant no longer falls; the start
with the least determinant gives the group's estimate. Quantiles come from histograms of narrow
bins and the moments from sums, so a step is two partial aggregates over the rows of the groups
that still move: no group is gathered, a group with a third of all rows costs no
more than many small ones. A group with fewer than ``least_rows`` rows uses its language's
estimate, then that of all rows; with fewer than that in all, nothing is rejected. A statistic that
hardly varies gets a floor under its variance; other variances stay as they are.

Defined cases: null text is empty text; a null language or source is a value of its own; repeated
rows count as often as they stand there; an empty table gives no rows; texts of any length are
counted whole; extra columns are ignored, but for the id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from depotry.llm.docstats import COUNTS, text_counts
from depotry.llm.shared import Workspace, forget

LEAST_WORDS, MOST_REPEATED = 20, 30
#: About half of a group's rows shape its estimate, so up to half of them can be junk.
KEEP = 0.5
#: Transformed statistics, in order; the least standard deviation of each, which only replaces a
#: smaller one; and a ridge that is added to all of them, so that any covariance has an inverse.
VECTOR = ("size", "word_length", "symbols", "dup_lines", "repeats", "variety", "capitals", "marks")
LEAST = (0.7, 0.1, 0.25, 0.8, 1.0, 0.15, 0.5, 0.5)
DIM = len(VECTOR)
FLOORS = (1e-3,) * DIM
BINS, RINGS = 64, 16  # bins for a unit of a statistic; for a factor 2 of a distance
#: The quantile of chi-square beyond which a distance is an outlier's: one of 10,000 rows of a Gaussian group.
QUANTILE = 0.9999


def chi2_cdf(x: float, dim: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def chi2_quantile(share: float, dim: int) -> float:
    """The value that ``share`` of a chi-square distribution lies below."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dim) < share else (low, mid)
    return low


def consistency(share: float, dim: int) -> float:
    """What the covariance of the nearest ``share`` of Gaussian rows must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, dim), dim + 2)


CUTOFF = chi2_quantile(QUANTILE, DIM)
STARTS = ("diagonal", "signs", "tanh")
#: Rows within this quantile of chi-square by the raw estimate make the final one.
WEIGHED = 0.975
#: Steps stop when the logarithm of the determinant falls by less; a step never raises it, so any stop is sound.
STILL, MOST_STEPS = 1e-4, 12
#: Estimates of so many groups (about 2 kB each with all starts) go to the tasks at once. Up to this number they are
#: broadcast to the rows at the end; more are joined by shuffle.
MOST_GROUPS = 10_000


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x0..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            c = text_counts(b.column(3))
            n, chars, symbols, dups, repeats, lines, distinct = (c[:, i].astype(float) for i in range(7))
            upper, marks = c[:, COUNTS.index("n_upper")], c[:, COUNTS.index("n_marks")]
            failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])
            w = np.maximum(n, 1)
            # Different words against what a text of this length usually has (a power law).
            vector = (np.log1p(n), np.log(np.maximum(chars, 1) / w), np.log1p(100 * symbols / np.maximum(chars, 1)), np.log1p(100 * dups / np.maximum(lines, 1)), np.log1p(100 * repeats / w), np.log(np.maximum(distinct, 1)) - 0.85 * np.log(w), np.log1p(100 * upper / np.maximum(chars, 1)), np.log1p(100 * marks / np.maximum(chars, 1)))
            names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"x{i}" for i in range(DIM))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), *map(pa.array, vector)], names)

    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"x{i} double" for i in range(DIM))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long"), *named, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _distance(m: str = "m", a: str = "a") -> Column:
    gaps = [F.col(f"x{i}") - F.col(m)[i] for i in range(DIM)]
    terms = [F.col(a)[i * DIM + j] * gaps[i] * gaps[j] * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def shaped(mean: np.ndarray, square: np.ndarray, grown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverse covariances and log determinants from means (n, DIM) and means of products (n, DIM, DIM)."""
    full = grown * (square - mean[:, :, None] * mean[:, None, :]) + np.diag(np.array(FLOORS) ** 2)
    own = np.arange(DIM)
    full[:, own, own] = np.maximum(full[:, own, own], np.array(LEAST) ** 2)
    return mean, np.linalg.inv(full), np.linalg.slogdet(full)[1]


def _cut(counts: DataFrame, by: list[str], share: Column) -> DataFrame:
    """The bin of each group in which the running count reaches ``share`` of the group."""
    every, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    reached = counts.withColumn("all", F.sum("n").over(every)).withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= share * F.col("all"))
    return reached.groupBy(*by).agg(F.min("bin").alias("bin"), F.max("all").alias("rows"))


def _medians(rows: DataFrame, work: Workspace, few: int) -> DataFrame:
    """(group, rows, m, scale): median and robust standard deviation of each statistic, floors under the latter."""
    long = rows.select("group", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(DIM)))).alias("i", "x")).withColumn("bin", F.floor(F.col("x") * BINS))
    bins = work.table(long.groupBy("group", "i", "bin").agg(F.count(F.lit(1)).alias("n")), "bins", few)
    quarters = [_cut(bins, ["group", "i"], F.lit(q)).select("group", "i", ((F.col("bin") + 0.5) / BINS).alias(f"q{int(100 * q)}"), *(["rows"] if q == 0.5 else [])) for q in (0.25, 0.5, 0.75)]
    spread = quarters[0].join(quarters[1], ["group", "i"]).join(quarters[2], ["group", "i"])
    floor, least = (F.element_at(F.array(*map(F.lit, v)), F.col("i") + 1) for v in (FLOORS, LEAST))
    scaled = spread.select("group", "i", "rows", F.col("q50").alias("m"), F.sqrt(F.greatest(F.pow((F.col("q75") - F.col("q25")) / 1.349, 2) + F.pow(floor, 2), F.pow(least, 2))).alias("d"))
    ordered = scaled.groupBy("group").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("i", "m", "d"))).alias("all"))  # DIM entries a group
    return work.table(ordered.select("group", "rows", F.col("all.m").alias("m"), F.col("all.d").alias("scale")), "medians", few)


def _by_state(rows: DataFrame, names: list[str], tell: Callable, schema: str) -> DataFrame:
    """``tell(x, which)`` of all rows of a task by batch: their statistics and the place of their group in ``names``, other groups left out."""
    place = {g: i for i, g in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                coded = b.column(0).dictionary_encode()
                known = np.array([place.get(g, -1) for g in coded.dictionary.to_pylist()], np.int64)
                which = known[coded.indices.to_numpy()] if b.num_rows else np.zeros(0, np.int64)
                x = np.stack([b.column(i + 1).to_numpy() for i in range(DIM)], axis=1)
                yield x[which >= 0], which[which >= 0]

        yield from tell(read())

    return rows.select("group", *(f"x{i}" for i in range(DIM))).mapInArrow(run, schema)


def _histogram(rows: DataFrame, names: list[str], m: np.ndarray, a: np.ndarray) -> dict[tuple[int, int], int]:
    """The ring of each (group, start) in which its nearest KEEP share ends."""

    def tell(read: Iterator) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for x, which in read:
            gap = x[:, None, :] - m[which]
            ring = np.floor(np.log2(np.einsum("nsi,nsij,nsj->ns", gap, a[which], gap) + 1e-6) * RINGS).astype(np.int64)
            for start in range(m.shape[1]):
                keys, n = np.unique(np.stack([which, ring[:, start]], axis=1), axis=0, return_counts=True)
                held.update(dict(zip(((g, start, r) for g, r in keys.tolist()), n.tolist(), strict=True)))
        columns = zip(*((*k, n) for k, n in held.items()), strict=True) if held else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["g", "start", "bin", "n"])

    rings = _by_state(rows, names, tell, "g long, start long, bin long, n long").groupBy("g", "start", "bin").agg(F.sum("n").alias("n"))
    return {(r["g"], r["start"]): r["bin"] for r in _cut(rings, ["g", "start"], F.lit(KEEP)).collect()}  # a row a group and start


def _moments(rows: DataFrame, names: list[str], starts: int, weigh: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, means of products) by group and start of the vectors that ``weigh(x, which)`` gives, with a mark of those that count."""
    low = np.triu_indices(DIM)
    width = DIM + len(low[0])

    def tell(read: Iterator) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(names) * starts, width)), np.zeros(len(names) * starts, np.int64)
        for x, which in read:
            z, keep = weigh(x, which)  # (n, starts, DIM), (n, starts)
            at = (which[:, None] * starts + np.arange(starts))[keep]
            z = z[keep]
            np.add.at(sums, at, np.concatenate([z, z[:, low[0]] * z[:, low[1]]], axis=1))
            np.add.at(counts, at, 1)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there]), *(pa.array(sums[there, i]) for i in range(width))], ["at", "n", *(f"s{i}" for i in range(width))])

    schema = "at long, n long, " + ", ".join(f"s{i} double" for i in range(width))
    made = _by_state(rows, names, tell, schema).groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()  # a row a group and start
    n, mean, square = np.zeros(len(names) * starts), np.zeros((len(names) * starts, DIM)), np.zeros((len(names) * starts, DIM, DIM))
    for r in made:
        values = np.array(r[2:]) / r["n"]
        n[r["at"]], mean[r["at"]] = r["n"], values[:DIM]
        square[r["at"]][low] = values[DIM:]
        square[r["at"]].T[low] = values[DIM:]
    return n, mean, square


def concentrate(rows: DataFrame, work: Workspace, most_steps: int = MOST_STEPS) -> DataFrame:
    """(group, rows, m, a, logdet) of the minimum-covariance-determinant estimate of every group of ``rows(group, x0..)``.

    The numbers of a group are few, so they are held by the driver and sent to the tasks, those
    of MOST_GROUPS groups at a time; the rows are aggregated where they lie.
    """
    known = _medians(rows, work, work.parts(0, 1))
    slices = -(-known.count() // MOST_GROUPS)
    dealt = lambda df: df.where(F.pmod(F.xxhash64("group"), F.lit(slices)) == number) if slices > 1 else df
    out = None
    for number in range(slices):
        made = _concentrated(dealt(rows), dealt(known).orderBy("group").collect(), most_steps)
        one = work.table(rows.sparkSession.createDataFrame(made, "group string, rows long, m array<double>, a array<double>, logdet double"), f"estimates-{number}", 1)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], "group string, rows long, m array<double>, a array<double>, logdet double")


def _concentrated(rows: DataFrame, known: list[Row], most_steps: int) -> list[tuple[str, int, list[float], list[float], float]]:
    names, total = [r["group"] for r in known], np.array([r["rows"] for r in known])
    centre, scale = np.array([r["m"] for r in known]).reshape(-1, DIM), np.array([r["scale"] for r in known]).reshape(-1, DIM)

    def turned(x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - centre[which]) / scale[which]
        unit = z / np.maximum(np.sqrt((z * z).sum(1)), 1e-6)[:, None]
        return np.stack([unit, np.tanh(z)], axis=1), np.ones((len(x), 2), bool)

    _, _, square = _moments(rows, names, 2, turned)
    width = np.sqrt(np.maximum(np.einsum("nii->ni", square), 1e-12))
    ties = 0.95 * square / (width[:, :, None] * width[:, None, :])
    own = np.arange(DIM)
    ties[:, own, own] = 1
    first = np.concatenate([np.broadcast_to(np.eye(DIM), (len(names), 1, DIM, DIM)), ties.reshape(len(names), 2, DIM, DIM)], axis=1)
    m = np.repeat(centre[:, None], len(STARTS), axis=1)
    a = np.linalg.inv(first * (scale[:, :, None] * scale[:, None, :])[:, None])
    det, moving, live = np.full(m.shape[:2], np.inf), np.ones(m.shape[:2], bool), np.arange(len(names))
    for _ in range(most_steps):
        some, at, inverse = [names[i] for i in live], m[live], a[live]
        cut = np.full(at.shape[:2], -(1 << 40))
        for (g, start), ring in _histogram(rows, some, at, inverse).items():
            cut[g, start] = ring

        def nearest(x: np.ndarray, which: np.ndarray, at: np.ndarray = at, inverse: np.ndarray = inverse, cut: np.ndarray = cut) -> tuple[np.ndarray, np.ndarray]:
            gap = x[:, None, :] - at[which]
            ring = np.floor(np.log2(np.einsum("nsi,nsij,nsj->ns", gap, inverse[which], gap) + 1e-6) * RINGS)
            return np.repeat(x[:, None, :], len(STARTS), axis=1), ring <= cut[which]

        _, mean, square = _moments(rows, some, len(STARTS), nearest)
        mean, inverse, logdet = shaped(mean, square, consistency(KEEP, DIM))
        g, start = np.nonzero(moving[live])
        to, of = (live[g], start), g * len(STARTS) + start
        old = det[to]
        m[to], a[to], det[to] = mean[of], inverse[of], logdet[of]
        moving[to] = old - det[to] >= STILL
        live = live[moving[live].any(1)]
        if not len(live):
            break
    best = det.argmin(1)
    pick = np.arange(len(names))
    m, a, det = m[pick, best], a[pick, best], det[pick, best]

    def within(x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = x - m[which]
        return x[:, None, :], (np.einsum("ni,nij,nj->n", gap, a[which], gap) <= chi2_quantile(WEIGHED, DIM))[:, None]

    n, mean, square = _moments(rows, names, 1, within)
    there = n > 0  # at least half of a group, but for rounding at the edge of floors
    mean, inverse, logdet = shaped(mean[there], square[there], consistency(WEIGHED, DIM))
    m[there], a[there], det[there] = mean, inverse, logdet
    return [(g, int(t), x.tolist(), y.ravel().tolist(), float(d)) for g, t, x, y, d in zip(names, total, m, a, det, strict=True)]


def apply_rules(docs: DataFrame, cutoff: float = CUTOFF, least_rows: int = 50, most_steps: int = MOST_STEPS) -> DataFrame:
    """(doc_id, counts, base_failed, distance2, kept); distance2 is null where no estimate applies."""
    work = Workspace(docs.sparkSession, "rules")
    known = work.table(statistics(docs), "statistics")
    levels = [F.concat_ws("\x01", F.lit("source"), "lang", "source"), F.concat_ws("\x01", F.lit("lang"), "lang"), F.lit("all")]
    vectors = [f"x{i}" for i in range(DIM)]
    every = known.where("NOT base_failed").select(*vectors, F.explode(F.array(*levels)).alias("group"))
    # Groups with fewer rows have no say, so that sources of a few rows, which can be many, leave here.
    used = work.table(every.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows).select("group"), "groups", work.parts(0, 1))
    sound = every.join(F.broadcast(used) if used.count() <= MOST_GROUPS else used, "group")
    state = concentrate(sound, work, most_steps)
    few = state.count() <= MOST_GROUPS
    out = known
    for k, level in enumerate(levels):
        one = state.select(F.col("group").alias(f"_g{k}"), F.col("m").alias(f"_m{k}"), F.col("a").alias(f"_a{k}"))
        out = out.join(F.broadcast(one) if few else one, level == F.col(f"_g{k}"), "left")
    distance = F.coalesce(*(F.when(F.col(f"_g{k}").isNotNull(), _distance(f"_m{k}", f"_a{k}")) for k in range(len(levels))))
    out = out.withColumn("distance2", distance)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"))
