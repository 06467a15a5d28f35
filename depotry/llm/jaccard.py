"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

Two texts link when |A n B| * den >= num * |A u B| for their sets of n-word shingles.

1. Frequencies: shingles are counted over all documents into sorted arrays on the shared folder;
   those of one document alone are not kept. Counting goes by the upper 48 bits of a hash: where
   two shingles share them a frequency is too high, which only loosens bounds. A document with
   fewer than a share num/den of repeated shingles can link with no other text and leaves here.
2. Equal sets are one class; its smallest id stands for it.
3. A representative orders its shingles by (frequency, hash). With its first |A| - t + l
   shingles, t = ceil(num/den * |A|), it shares at least l with any partner's prefix of the same
   l; a partner with another l shares at least the smaller. Each document picks its l by
   estimated cost: postings that a longer prefix meets against verifications that a stricter
   requirement saves.
4. Candidates are verified exactly. First every document against a few leaders of the buckets
   (shingles) of its prefix. Then, only where a bucket still holds documents of different
   groups, those outside the bucket's largest group against all others in it; a pair inside a
   group would tell nothing new. Bounds are part of the join: repeated shingles and sizes bound
   the overlap, and the parity signatures of two sets (each shingle flips one of ``BITS`` bits)
   differ in no more bits than the sets differ in shingles.
5. Connected components of the verified links.

``jaccard_groups`` needs no more links than connect each group, and step 4 leaves out the rest.
``jaccard_join`` gives every link: step 4 joins the buckets in full, whatever group a document is
in, and verifies each pair. Its rows grow with the square of a group of differing texts, as the
links do; equal texts are one class and add none. ``link_counts`` is a document's number of links.

Nothing is capped: buckets, partners and candidates are joined in full.

Defined cases: null, empty or blank texts have no shingles and link with nothing; texts shorter
than n words are one shingle; repeated rows and equal texts are one group; rows that repeat an id
with another text are separate documents; a row with a null id never stands for a group unless
all its copies have none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotry.llm.components import components
from depotry.llm.hashcount import PARTS_SCHEMA, Shards, merged, parts, write_shard
from depotry.llm.shared import Workspace, get_array, join_by_key, put_array, split_sorted, text_bytes
from depotry.llm.textscan import scan, shingles

#: Bytes of text behind one shard of shingles.
SHARD = 6 << 20
#: Bytes of a hash that are counted, and the lower bits that are not.
COUNTED, LOWER = 6, np.uint64(16)
MATCHES = (1, 2, 3, 4, 6, 8)
#: Cost of verifying one candidate, in postings for each shingle of the document.
VERIFY = 0.05
#: Leaders of a bucket, and how many of them a document is verified against at first.
LEADERS, TRIED = 7, 3
BITS = 512
#: Ids of rows to leave out (8 bytes each) up to this number are broadcast; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Tokens in one of the arrays from which all links are verified.
TOKENS_FILE = 4 << 20
#: Sets behind one part of the tables of postings and links.
SETS_PART = 2_000
#: Sizes are grouped in steps of a factor 2 ** (1 / 32) for the join.
STEPS = 32


def _upper(tokens: np.ndarray) -> np.ndarray:
    """Distinct upper bits of sorted tokens."""
    upper = tokens >> LOWER
    return upper[np.concatenate(([True], upper[1:] != upper[:-1]))] if len(upper) else upper


def count_repeated(docs: DataFrame, work: Workspace, n: int) -> Shards:
    """Sorted arrays of the shingles that at least two documents have, with their frequencies."""
    shards, folder = max(8, text_bytes(docs) // SHARD), work.folder("shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[np.ndarray, None]]:
            for b in batches:
                for _, w, o in scan(b.column(0)):
                    yield np.concatenate([_upper(shingles(w[i:j], n)) for i, j in zip(o[:-1], o[1:], strict=True)]), None

        return parts(pieces(), lambda keys: split_sorted(keys << LOWER, shards), COUNTED)

    def finish(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        again = counts > 1
        write_shard(folder, shard, keys=keys[again], times=np.minimum(counts[again], 0xFFFFFFFF).astype(np.uint32))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(again.sum())])})

    made = merged(docs.select("text").mapInArrow(count, PARTS_SCHEMA), shards, finish, "shard int, n long", COUNTED)
    return Shards(folder, {r["shard"]: r["n"] for r in made.collect()}, shards, shift=int(LOWER))  # a row for each shard


def parity(tokens: np.ndarray) -> list[int]:
    """Bit b is the parity of the tokens whose lowest bits are b."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def document_sets(docs: DataFrame, repeated: Shards, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, fp, tokens, times, sig): set size and fingerprint; the repeated shingles where enough of them are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, w, o in scan(b.column(1)):
                own = [shingles(w[i:j], n) for i, j in zip(o[:-1], o[1:], strict=True)]
                flat = np.concatenate(own)
                keys, back = np.unique(flat >> LOWER, return_inverse=True)
                times = np.zeros(len(keys), np.uint32)
                for shard, where, place, there in repeated.find(keys):
                    times[where] = np.where(there, get_array(repeated.uri(shard, "times"), "u4")[place], 0)
                times, at = times[back], 0
                for s in own:
                    t = times[at : at + len(s)]
                    at += len(s)
                    keep = len(s) > 0 and den * np.count_nonzero(t) >= num * len(s)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[t > 0].tobytes() if keep else None, t[t > 0].tobytes() if keep else None, parity(s) if keep else None))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "fp", "tokens", "times", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp binary, tokens binary, times binary, sig array<long>")


def choose_matches(times: np.ndarray, size: int, least: int, unique: int, matches: tuple[int, ...] = MATCHES) -> tuple[int, int]:
    """(l, repeated shingles in the prefix) of least estimated cost; ``times`` in prefix order."""
    meets = np.concatenate(([0], np.cumsum(times.astype(np.float64) - 1)))
    best = None
    for l in matches:
        l = min(l, max(1, least))
        reach = max(0, min(size - least + l - unique, len(times)))
        cost = meets[reach] * (1 + VERIFY * size / l)
        if best is None or cost < best[0]:
            best = (cost, l, reach)
    return best[1], best[2]


def postings(sets: DataFrame, num: int, den: int, matches: tuple[int, ...] = MATCHES) -> DataFrame:
    """(token, cid, n, o, l): the prefix of each representative; o is its number of repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for cid, n, tokens, times in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                keys, t = np.frombuffer(tokens, np.int64), np.frombuffer(times, np.uint32)
                order = np.lexsort((keys, t))
                l, reach = choose_matches(t[order], n, -(-num * n // den), n - len(keys), matches)
                for c, v in zip(out, (keys[order[:reach]], *(np.full(reach, x) for x in (cid, n, len(keys), l))), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in out], ["token", "cid", "n", "o", "l"])

    return sets.select("cid", "n", "tokens", "times").mapInArrow(run, "token long, cid long, n long, o long, l long")


def _possible(num: int, den: int, a: str, b: str) -> str:
    """What two documents with n, o and sig must meet to link."""
    return f"least({a}.o, {b}.o) * {num + den} >= {num} * ({a}.n + {b}.n) AND {_apart(a, b)} * {num + den} <= {den - num} * ({a}.n + {b}.n)"


def _apart(a: str, b: str) -> str:
    """Bits in which two signatures differ."""
    return "(" + " + ".join(f"bit_count({a}.sig[{i}] ^ {b}.sig[{i}])" for i in range(BITS // 64)) + ")"


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, ta, nb, tb in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                both = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                keep.append(den * both >= num * (na + nb - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def _stepped(held: DataFrame) -> DataFrame:
    return held.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * STEPS))


def _meeting(some: DataFrame, held: DataFrame, where: str, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``some`` x and ``held`` y, both of ``_stepped``, that share enough of their prefixes."""
    highest = F.col("o") * F.lit((num + den) / num) - F.col("n")  # no larger partner can share enough
    low, high = F.floor(F.log2(F.col("n") * F.lit(num / den)) * STEPS), F.floor(F.log2(highest) * STEPS)
    reach = some.withColumn("_low", low - 1).withColumn("_high", F.least(high + 1, F.col("step") + (F.col("step") - low) + 2)).where("_high >= _low").withColumn("step", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    crossing = reach.alias("x").join(held.alias("y"), ["token", "step"]).where(f"{where} AND {_possible(num, den, 'x', 'y')}")
    return crossing.groupBy(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x.l", "y.l")).alias("need")).where("shared >= need").select("a", "b")


def links(sets: DataFrame, work: Workspace, num: int, den: int, matches: tuple[int, ...] = MATCHES) -> DataFrame:
    """Verified links between representatives, enough to connect all that link."""
    parts = work.parts(sets.count(), SETS_PART)
    post = work.table(postings(sets, num, den, matches), "postings")
    # The leaders of a bucket are minima, so they come from partial aggregates: the document with
    # the fewest shingles of its own, and members that hashes pick, alike in every bucket.
    own = F.min(F.struct((F.col("n") - F.col("o")).alias("by"), "cid", "l"))
    picked = [F.min(F.struct(F.xxhash64("cid", F.lit(r)).alias("by"), "cid", "l")) for r in range(1, LEADERS)]
    buckets = post.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.array_distinct(F.array(*(F.struct(m["cid"].alias("cid"), m["l"].alias("l")) for m in (own, *picked)))).alias("leaders")).where("held > 1")
    buckets = work.table(buckets, "buckets", parts)
    post = work.table(join_by_key(post, buckets, "token", "held").select("token", "cid", "n", "o", "l", "leaders"), "shared", parts)
    led = post.select("cid", "l", F.explode("leaders").alias("lead")).where("lead.cid <> cid")
    tried = led.groupBy("cid", F.col("lead.cid").alias("leader")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("l", "lead.l")).alias("need")).where("shared >= need")
    marks = sets.select("cid", "n", "o", "sig")
    near = tried.select("cid", "leader").join(marks.select("cid", F.struct("n", "o", "sig").alias("x")), "cid").join(marks.select(F.col("cid").alias("leader"), F.struct("n", "o", "sig").alias("y")), "leader")
    ranked = near.where(_possible(num, den, "x", "y")).withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy(F.expr(_apart("x", "y")), "leader")))
    first = work.table(ranked.where(F.col("nth") <= TRIED).select(F.col("cid").alias("a"), F.col("leader").alias("b")), "tried", parts)
    stars = work.table(verified(first, sets, num, den), "stars", parts)
    groups = components(stars, work, "stars-groups", parts)
    post = work.table(post.select("token", "cid", "n", "o", "l").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("g", F.coalesce("component", "cid")).drop("component"), "grouped", parts)

    # Where a bucket holds several groups: all but its largest against everything in it.
    sizes = post.groupBy("token", "g").agg(F.count(F.lit(1)).alias("held"))
    mixed = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("held", "g")).alias("top")).where("groups > 1").select("token", F.col("top.g").alias("top"))
    held = work.table(_stepped(post.join(mixed, "token").join(marks.select("cid", "sig"), "cid")), "mixed", parts)
    rest = _meeting(held.where("g <> top"), held, "x.g <> y.g AND (y.g = y.top OR x.cid < y.cid)", num, den)
    more = work.table(verified(work.table(rest, "candidates", parts), sets, num, den), "crossing", parts)
    return stars.unionByName(more)


def all_links(sets: DataFrame, work: Workspace, num: int, den: int, matches: tuple[int, ...] = MATCHES) -> DataFrame:
    """Every link (a, b), a < b, between representatives.

    Pairs are many where groups are large, so they carry no sets: workers read those from arrays
    on the shared folder.
    """
    parts, folder = work.parts(sets.count(), SETS_PART), work.folder("arrays")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kept, at = [], [], 0

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex  # a task that runs twice leaves two files; the rows name one of them
            put_array(f"{folder}/{name}", np.concatenate(kept))
            return pa.RecordBatch.from_pydict({"cid": pa.array([r[0] for r in rows], pa.int64()), "place": pa.array([{"file": name, "at": a, "o": o, "n": n} for _, n, a, o in rows], pa.struct({"file": pa.string(), "at": pa.int64(), "o": pa.int64(), "n": pa.int64()}))})

        for b in batches:
            for cid, n, tokens in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kept.append(np.frombuffer(tokens, np.uint64))
                rows.append((cid, n, at, len(kept[-1])))
                at += len(kept[-1])
                if at >= TOKENS_FILE:
                    yield flush()
                    rows, kept, at = [], [], 0
        if rows:
            yield flush()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own(p: dict) -> np.ndarray:
            return get_array(f"{folder}/{p['file']}", "u8")[p["at"] : p["at"] + p["o"]]

        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                few, many = sorted((own(x), own(y)), key=len)
                both = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few) if len(few) else 0
                keep.append(den * both >= num * (x["n"] + y["n"] - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    places = work.table(sets.select("cid", "n", "tokens").mapInArrow(store, "cid long, place struct<file:string,at:long,o:long,n:long>"), "places", parts)
    post = work.table(postings(sets, num, den, matches), "postings")
    shared = post.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    held = work.table(_stepped(post.join(shared, "token").join(sets.select("cid", "sig"), "cid")), "held", parts)
    work.remove("postings")
    pairs = work.table(_meeting(held, held, "x.cid < y.cid", num, den), "candidates", parts)
    work.remove("held")
    known = pairs.join(places.select(F.col("cid").alias("a"), F.col("place").alias("x")), "a").join(places.select(F.col("cid").alias("b"), F.col("place").alias("y")), "b")
    return work.table(known.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links", parts)


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, matches: tuple[int, ...] = MATCHES) -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, n_shingles, class_id) for every row, and each link (a, b), a < b, between classes.

    Rows of equal sets are a class and link with one another; rows without shingles have none.
    Classes are numbered by rows and not by ids, which may be null or repeated.
    """
    work = Workspace(docs.sparkSession, "jaccard-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = work.table(document_sets(docs, count_repeated(docs, work, n), n, num, den).withColumn("row", F.monotonically_increasing_id()), "sets")
    work.remove("shingles")
    classes = work.table(known.where("n > 0").groupBy("fp").agg(F.min("row").alias("cid"), F.count(F.lit(1)).alias("copies")), "classes")
    own = known.where("tokens IS NOT NULL").join(classes.select("cid"), F.col("row") == F.col("cid"))
    sets = work.table(own.select("cid", "n", F.expr("length(tokens) div 8 AS o"), "tokens", "times", "sig"), "representatives")
    named = join_by_key(known.where("n > 0").select("doc_id", "n", "fp"), classes, "fp", "copies").select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"))
    alone = known.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"))
    members = work.table(named.unionByName(alone), "members")
    work.remove("sets")
    return members, all_links(sets, work, num, den, matches)


def link_counts(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, matches: tuple[int, ...] = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, n_links) for every row: the number of other rows that it links with, copies among them."""
    members, pairs = jaccard_join(docs, n, num, den, matches)
    classes = members.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes, F.col("b") == F.col("class_id")).groupBy("a").agg(F.sum("copies").alias("others"))
    known = classes.join(others, F.col("class_id") == F.col("a"), "left").select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(known, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, matches: tuple[int, ...] = MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``; ``matches`` are the l to choose from."""
    work = Workspace(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = work.table(document_sets(docs, count_repeated(docs, work, n), n, num, den), "sets")
    work.remove("shingles")
    classes = work.table(known.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("copies")), "classes")
    own = known.where("tokens IS NOT NULL").join(classes.withColumnRenamed("fp", "_fp"), (F.col("doc_id") == F.col("cid")) & (F.col("fp") == F.col("_fp")))
    sets = work.table(own.select("cid", "fp", "n", F.expr("length(tokens) div 8 AS o"), "tokens", "times", "sig").dropDuplicates(["cid", "fp"]), "representatives")
    groups = components(links(sets, work, num, den, matches), work, parts=work.parts(sets.count(), SETS_PART))
    # Only groups of several classes are joined by class; all copies of a class have its component then.
    of_class = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("fp", "copies", F.coalesce("component", "cid").alias("component"))
    of_class = work.table(of_class, "components-by-class")
    named = join_by_key(known.where("n > 0").select("doc_id", "n", "fp"), of_class, "fp", "copies").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    alone = known.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return named.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each, that of the smallest id.

    Where ids are null or repeated, rows are numbered first and the smallest number stays.
    """
    work, key = Workspace(docs.sparkSession, "representatives"), "doc_id"
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("distinct")).first()
    if not ids["rows"] == ids["known"] == ids["distinct"]:
        docs, key = work.table(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
    groups = jaccard_groups(docs.select(F.col(key).alias("doc_id"), "text"), n, num, den)
    gone = work.table(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")), "gone")
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("__gone"), "left_anti").drop("__row")
