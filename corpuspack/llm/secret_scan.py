"""Secrets in texts: three base patterns, and strings of high entropy.

Base spans are the leftmost, non-overlapping matches of three patterns that pass their checks: values
assigned to a telling name, access key ids, long hexadecimal strings. They stay whatever follows.

Candidates for further spans are whole runs of at least ``WINDOW`` letters, digits and ``+ / _ -`` (and
the ``=`` that may end them). A run of hexadecimal digits is of class ``hex``, any other of class
``base64``. Over each run slides a window of ``WINDOW`` characters; its Shannon entropy is kept by the
counts of the one character that enters and the one that leaves, each of which changes one term of
``sum(c * log2(c))``. The terms are whole millionths, so that a sum doesn't depend on the way it was
reached. A run whose highest window reaches its class's entropy is a span of kind ``entropy_hex`` or
``entropy_base64``, unless it lies in a base span or the allow-list knows it: identifiers in their usual
form, words joined by signs, numbers, alphabets, placeholders, check sums named as such, paths of
addresses and embedded files. Long runs are cut into overlapping pieces by one pattern, so that the
work grows with their length.

All work is native and stays in the document's row; nothing is shuffled.

Defined results: null or empty text has no span; null ids and repeated rows are kept; very long texts are
scanned whole; spans of one kind never overlap, so spans at the same place differ in kind and are listed
in the order of the kinds; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.pii import running

BASE_KINDS = ("assign", "access", "hex")
CLASSES = ("hex", "base64")
KINDS = (*BASE_KINDS, *[f"entropy_{c}" for c in CLASSES])

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
# The base patterns. Runs are entered at their first character and don't give back; a
# shorter access key or hexadecimal run fails wherever it is entered, an assigned value is checked after.
BASE = {
    "assign": f"{_ASSIGN}{_VALUE}++",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
#: A cheap look for what a pattern needs.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"(?<![0-9a-f])[0-9a-f]{16}"}
ASSIGNED = 12

WINDOW = 20
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Bits per character that a window must reach; of 20 random characters some 3.4 and 4.0 are usual,
#: words have up to 3.6.
ENTROPY = {"hex": 3.0, "base64": 3.7}
#: Windows of a run that begin in one piece.
PIECE = 256
SCALE = 1_000_000

# The allow-list, patterns of a whole run and of the text right before it.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]+(?:[+/_-]+[A-Za-z]+)*[+/_-]*=*$",
    r"^[0-9+/_-]+=*$",
    r"(?i)example|placeholder|changeme|dummy|your[_-]|x{6}|0123456789|abcdefgh",
)
ALLOWED_BEFORE = (
    r"(?i)(?:sha-?(?:1|256|384|512)|md5|checksum|digest|integrity|commit)[\x22' ]*[:=]?[\x22' ]*$",
    r"(?i)[a-z]{3,8}://[^\s?\x22'<>]*$",
    r"(?i)base64,$",
)
BEFORE = 200


def places(text: Column, strings: Column, pattern: str) -> Column:
    """start, end (code points) and string of each match of a pattern, from its strings; the text
    between them, split once, says where."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(strings), F.lit(0)))
    lengths = F.zip_with(strings, gaps, lambda m, gap: (F.length(m) + F.length(gap)).cast("long"))
    return F.when(F.size(strings) > 0, F.zip_with(running(lengths), strings, lambda end, m: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), m.alias("string")))).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,string:string>>"))


def terms() -> list[int]:
    """c * log2(c) for c = 0 .. WINDOW, in millionths."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]


def least_sum(piece: Column) -> Column:
    """The least sum of terms of any window in a piece; NULL where it is shorter than a window.

    One step per character: the counts of the character that leaves and of the one that enters, in
    the window between them, say how the sum changes.
    """
    t = terms()
    gains = F.array(*[F.lit(b - a).cast("long") for a, b in zip(t, t[1:])])  # of one more, by the count before

    def count(part: Column, char: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, char, F.lit("")))

    def step(state: Column, j: Column) -> Column:
        kept = F.substring(piece, F.greatest(j - (WINDOW - 2), F.lit(1)), F.least(j, F.lit(WINDOW - 1)))
        left = F.when(j >= WINDOW, F.get(gains, count(kept, F.substring(piece, j - (WINDOW - 1), F.lit(1))))).otherwise(0)
        total = state["total"] - left + F.get(gains, count(kept, F.substring(piece, j + 1, F.lit(1))))
        least = F.when(j >= WINDOW - 1, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(total.cast("long").alias("total"), least.cast("long").alias("least"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("least"))
    return F.when(F.length(piece) >= WINDOW, F.aggregate(
        F.sequence(F.lit(0), F.length(piece) - 1), start, step, lambda s: s["least"]))


def highest_entropy(string: Column) -> Column:
    """The highest entropy of a run's windows, in bits per character."""
    chars = F.regexp_replace(string, "=+$", "")
    pieces = F.regexp_extract_all(chars, F.lit(f"(?s)(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    least = F.array_min(F.transform(pieces, least_sum))
    return F.lit(math.log2(WINDOW)) - least / F.lit(WINDOW * SCALE)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (spans that pass) and runs (start, end, string) of each row of docs."""
    step = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    patterns, hints = BASE | {"run": RUN}, HINTS | {"run": RUN}
    step = step.withColumns({k: F.when(text.rlike(hints[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, p in patterns.items()})
    step = step.withColumns({k: places(text, F.col(k), p) for k, p in patterns.items()})
    value = f"^{_ASSIGN}({_VALUE}+)$"
    assign = F.filter("assign", lambda x: F.length(F.regexp_extract(x["string"], value, 1)) >= ASSIGNED)

    def spans(kind: str, of: Column) -> Column:
        return F.transform(of, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"),
            F.lit(True).alias("base"), F.lit(None).cast("double").alias("bits")))

    base = F.concat(spans("assign", assign), *[spans(k, F.col(k)) for k in BASE_KINDS[1:]])
    return step.select("doc_id", "text", base.alias("base"), F.col("run").alias("runs"))


def allowed(text: Column, run: Column, more: Sequence[str]) -> Column:
    """Whether the allow-list knows a run by its form or by what stands before it."""
    first = F.greatest(run["start"] - BEFORE, F.lit(0))
    before = F.substring(text, (first + 1).cast("int"), (run["start"] - first).cast("int"))
    tests = [run["string"].rlike(p) for p in (*ALLOWED, *more)] + [before.rlike(p) for p in ALLOWED_BEFORE]
    return F.exists(F.array(*tests), lambda x: x)


def secrets(docs: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """doc_id and spans (kind, start, end, base, and of added ones the bits of their highest window; by
    start and kind) of each row of docs. ``allow`` has further patterns of runs to be left alone."""
    rows = candidates(docs)
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    free = F.filter(free, lambda r: ~allowed(F.col("text"), r, allow))
    is_hex = lambda r: r["string"].rlike("^[0-9A-Fa-f]+$")
    scored = F.transform(free, lambda r: F.struct(
        r["start"].alias("start"), F.when(is_hex(r), KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64")).alias("rank"),
        r["end"].alias("end"), F.lit(False).alias("base"), highest_entropy(r["string"]).alias("bits")))
    limit = lambda r: F.when(r["rank"] == KINDS.index("entropy_hex"), ENTROPY["hex"]).otherwise(ENTROPY["base64"])
    rows = rows.select("doc_id", "base", scored.alias("scored"))
    spans = F.sort_array(F.concat("base", F.filter("scored", lambda r: r["bits"] >= limit(r))))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return rows.select("doc_id", F.transform(spans, lambda x: F.struct(
        F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        x["base"].alias("base"), x["bits"].alias("bits"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and spans as one string."""
    base = F.filter("spans", lambda x: x["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
