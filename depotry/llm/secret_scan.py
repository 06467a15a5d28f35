"""Secret scan with DataFrame functions only.

Base kinds are patterns; their leftmost matches that do not overlap, less those that fail the
kind's rule. The method adds spans of high entropy: a candidate is a whole run of a character
class, a window slides over it with incremental counts (one character in, one out, the sum of
c*log2(c) kept up to date), and a candidate with any window of enough Shannon entropy is a span
unless the allow-list knows it. Base spans stay whatever the allow-list says.

Positions are code points, end exclusive. They come from the lengths of the matches and of what
``split`` leaves between them, so no function outside Spark's own is needed.

Defined cases: null text is empty text and has no spans; repeated rows and ties are rows of
their own; an empty table gives no rows; texts of any length are scanned whole; extra columns
are kept, but for ones named as the results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``alphabet`` of at least ``window`` characters and the bits a character that make one suspicious."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_-])", "0123456789abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
)

#: Candidates that hold one of these (in any case) are no secrets: placeholders, runs of the
#: alphabet, and the well-known digests of empty input.
ALLOWED = (
    "example", "placeholder", "changeme", "dummy", "sample", "xxxx", "00000000", "0123456789", "1234567890", "abcdefgh",
    "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


#: Hits that one inner fold places; the outer fold carries their lists, so that placing takes time in line with the hits.
HITS_BLOCK = 256
#: Windows of a run that are looked at together; blocks overlap by a window less one character.
RUN_BLOCK = 1024


def located(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, hit>> of the pattern's matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(F.split(text, pattern, -1).alias("between"), hits.alias("hits"))
    spans = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"
    none, nothing = (F.expr(f"CAST(array() AS {t})") for t in (spans, f"array<{spans}>"))

    def walk(found: Column) -> Column:
        def place(state: Column, i: Column) -> Column:
            hit = F.element_at(found["hits"], i)
            start = state["at"] + F.length(F.element_at(found["between"], i))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(hit)).alias("end"), hit.alias("hit"))
            return F.struct((start + F.length(hit)).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

        def block(state: Column, first: Column) -> Column:
            last = F.least(F.size(found["hits"]), first + (HITS_BLOCK - 1))
            some = F.aggregate(F.sequence(first, last), F.struct(state["at"].alias("at"), none.alias("out")), place)
            return F.transform(F.array(some), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out")))[0]

        zero = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(found["hits"]), F.lit(HITS_BLOCK)), zero, block, lambda state: F.flatten(state["out"]))

    # A one-element array carries the two lists into one lambda, so that each is made once.
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(parts), walk))).otherwise(none)


def window_entropy(places: Column, size: int, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of any ``window`` neighbours of an array of places 1..``size``.

    A step counts one character in and, once the window is full, one out: two entries of the
    counts change and the sum of c * log2(c) with them.
    """

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def moved(state: Column, at: Column, by: int) -> Column:
        """``state`` with one more or one less of the character at ``at``."""

        def entry(s: Column) -> Column:  # place and count of the character, both needed more than once
            counts = F.concat(F.slice(state["counts"], F.lit(1), s["place"] - 1), F.array(s["old"] + by), F.slice(state["counts"], s["place"] + 1, F.lit(size) - s["place"]))
            return F.struct(counts.alias("counts"), (state["sum"] + weight(s["old"] + by) - weight(s["old"])).alias("sum"), state["low"].alias("low"))

        place = F.element_at(places, at)
        return F.transform(F.array(F.struct(place.alias("place"), F.element_at(state["counts"], place).alias("old"))), entry)[0]

    def step(state: Column, i: Column) -> Column:
        inside = F.transform(F.array(moved(state, i, 1)), lambda s: F.when(i > window, moved(s, i - window, -1)).otherwise(s))
        return F.transform(inside, lambda s: F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.when(i >= window, F.least(s["low"], s["sum"])).otherwise(s["low"]).alias("low")))[0]

    start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))
    least = F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda s: s["low"])
    return F.log2(F.lit(float(window))) - least / F.lit(float(window))


def reaches(run: Column, c: CharacterClass) -> Column:
    """Whether any window of a run of the class has at least its bits; the run is read in blocks, up to the first that has."""
    raw = run.cast("binary")  # the classes are ASCII: a byte is a character, and a part of it is cut without a scan

    def block(first: Column) -> Column:
        chars = F.split(F.substring(raw, first, F.lit(RUN_BLOCK + c.window - 1)).cast("string"), "", -1)
        places = F.filter(F.transform(chars, lambda x: F.when(x != "", F.instr(F.lit(c.alphabet), x)).otherwise(0)), lambda n: n > 0)
        # A window of d different characters has log2(d) bits at most, so most blocks of dull runs need no counting.
        varied = F.filter(F.array(places), lambda p: F.size(F.array_distinct(p)) >= math.ceil(2**c.bits - 1e-9))
        return F.exists(varied, lambda p: window_entropy(p, len(c.alphabet), c.window) >= c.bits)

    return F.exists(F.sequence(F.lit(1), F.octet_length(run) - (c.window - 1), F.lit(RUN_BLOCK)), block)


def _suspicious(c: CharacterClass) -> Callable[[Column], Column]:
    known = "(?i)" + "|".join(ALLOWED)
    return lambda s: ~s["hit"].rlike(known) & reaches(s["hit"], c)


def of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def scan_secrets(docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """``docs`` without its text and with ``found``: array<struct<start, kind, end, hit>> by start, then kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = [
        F.filter(located(body, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST),
        F.filter(located(body, ACCESS, 1), lambda s: F.length(s["hit"]) >= ACCESS_LEAST),
        located(body, HEX.replace("+", f"{{{HEX_LEAST},}}"), 2),  # a run of fewer is no match of any kind
    ]
    for number, c in enumerate(classes, 3):
        kinds.append(F.filter(located(body, c.pattern, number), _suspicious(c)))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text.lower(), "found")]
    return docs.select(*rest, F.array_sort(F.concat(*kinds)).alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
