"""Personal data: pattern spans, and spans added by weak supervision.

Base spans are the leftmost, non-overlapping matches of four patterns that pass their checks.
They stay whatever the method says. Looser patterns give further candidates (a number right
before another, a card in a longer row of digits, a written-out address).

Labelers vote on each candidate (1 for, -1 against, 0 none): its form, its check sum or range, a
gazetteer of endings, prefixes and networks, the words before it and the characters around it.
The votes of all candidates of the corpus are counted by kind and pattern of votes, at most
``4 * 3**5`` rows. Expectation-maximisation over these counts estimates for each labeler how often
it votes which way on true and on false candidates; a logistic classifier on the votes, weighted
by the counts and with the posteriors as soft labels, is trained on them and decides on the
candidates that are no base spans and touch none.

All work on texts is native; the driver sees the pattern counts only. Candidates stay in their
document's row, so nothing of the texts is shuffled.

Defined results: null or empty text has no span; null ids and repeated rows are kept; ties between
spans of one kind don't occur, as matches don't overlap; other columns are not read; an empty
table gives an empty table (without candidates no model is fitted and nothing is added).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpuspack.session import materialize

KINDS = ("email", "ip", "card", "phone")

# Base patterns, in forms that don't try one place twice in a run of characters: a run is entered
# at its first character (or where the last match ended), and repeats don't give back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole rows of digits with at most one space or hyphen between two, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text that doesn't contain this has no match of the kind.
HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A cheap look for what the looser patterns need.
LOOSE_HINTS = {"email": r"[\[(]at[\])]", "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}

OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])] ?)(?:com|net|org|edu|gov|int|info|biz|io|eu|de|fr|es|it|nl|pl|uk|us|ch|at|be|br|ca|au|in|jp|mx)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ .(0-9-]|\()",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|from)",
    "card": r"(?i)(?:card|visa|credit|debit|account|payment)",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|contact)",
}
AGAINST = r"(?i)(?:\bversion|\bisbn|\bdoi|\bsection|\bchapter|\bserial|\border)\W*$"
LABELERS = ("form", "check", "gazetteer", "context", "edge")
AROUND = 40


def running(values: Column, block: int = 128) -> Column:
    """Sums of the values up to each one, themselves included. In blocks, as appending to an array
    copies it."""

    def sums(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<long>"), lambda done, x: F.concat(
            done, F.array(x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long")))))

    last = F.floor((F.size(values) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.transform(sums(totals), lambda t, i: t - F.get(totals, i))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, before, lambda part, b: F.transform(
        sums(part), lambda x: x + b)))).otherwise(F.array().cast("array<long>"))


def found(text: Column, pattern: str, there: Column) -> Column:
    """start, end (code points) and string of each match; the text between matches says where."""
    strings = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(strings, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))
    return F.when(F.size(strings) > 0, F.zip_with(running(lengths), strings, lambda end, m: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), m.alias("string"))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the check sum of a string's digits is right."""
    d = F.reverse(digits(s))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).cast("int") * (
        F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """The check of a kind's strings."""
    return {"email": lambda: F.lit(True), "ip": lambda: s.rlike(OCTETS), "card": lambda: luhn(s),
            "phone": lambda: F.length(digits(s)).between(9, 15)}[kind]()


def vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0; without ``no`` what isn't for is against."""
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def judged(text: Column, kind: str, span: Column, base: bool) -> Column:
    """A candidate with its votes."""
    s = span["string"]
    before = F.substring(text, F.greatest(span["start"] - AROUND + 1, F.lit(1)).cast("int"), F.least(
        span["start"], F.lit(AROUND)).cast("int"))
    left, right = F.substring(text, span["start"].cast("int"), F.lit(1)), F.substring(text, (span["end"] + 1).cast("int"), F.lit(1))
    strict = {"email": s.contains("@"), "ip": s.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
              "card": s.rlike("^" + LOOSE["card"].replace("(?<![0-9])", "").replace("(?![0-9])", "") + "$"),
              "phone": s.rlike("^" + LOOSE["phone"].replace("(?<![0-9+(])", "").replace("(?![0-9])", "") + "$")}[kind]
    check = {"email": F.length(s) <= 254}.get(kind, passes(kind, s))
    # an address written out has no strict form to be measured by
    votes = [vote(strict, F.lit(False) if kind == "email" else None), vote(check), vote(s.rlike(GAZETTEER[kind])),
             vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)),
             vote(~(F.concat(F.when(span["start"] > 0, left).otherwise(F.lit("")), right).rlike("[A-Za-z0-9]")))]
    return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), span["start"].alias("start"),
                    span["end"].alias("end"), F.lit(base).alias("base"),
                    *[v.alias(n) for v, n in zip(votes, LABELERS, strict=True)])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of spans by kind and start) and other candidates."""
    step = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    for kind in KINDS:
        there = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else digit
        step = step.withColumn(f"all_{kind}", found(text, BASE[kind], there))
    for kind in LOOSE:
        step = step.withColumn(f"loose_{kind}", found(text, LOOSE[kind], text.rlike(LOOSE_HINTS[kind])))
    none = F.array().cast("array<struct<start:bigint,end:bigint,string:string>>")

    def several(name: str, kind: str, base: bool, good: bool | None = None) -> Column:
        """The matches of a column; ``good``: those that pass the kind's check or that don't."""
        spans = F.coalesce(name, none)
        if good is not None:
            spans = F.filter(spans, lambda x: passes(kind, x["string"]) == F.lit(good))
        return F.transform(spans, lambda x: judged(text, kind, x, base))

    base = F.concat(*[several(f"all_{k}", k, True, True) for k in KINDS])
    # matches that fail their check are no candidates for the result, but the labelers learn from them
    failed = F.concat(*[several(f"all_{k}", k, False, False) for k in KINDS])
    loose = F.concat(*[several(f"loose_{k}", k, False) for k in LOOSE])
    return step.select("doc_id", base.alias("base"), failed.alias("failed"), loose.alias("loose"))


def votes_of(row: Row) -> tuple[int, ...]:
    return tuple(row[n] for n in LABELERS)


def reliabilities(rows: Sequence[Row], rounds: int = 50) -> list[float]:
    """Posterior of each row (kind, votes, n) to be true, by expectation-maximisation: per kind a
    rate of true candidates, per labeler the rates of its votes on true and false ones."""
    post = [1 / (1 + math.exp(-float(sum(votes_of(r))))) for r in rows]
    for _ in range(rounds):
        prior, like = {}, {}
        for truth in (0, 1):
            share = [r["n"] * (p if truth else 1 - p) for r, p in zip(rows, post, strict=True)]
            for r, w in zip(rows, share, strict=True):
                prior[truth, r["kind"]] = prior.get((truth, r["kind"]), 1.0) + w
                for i, v in enumerate(votes_of(r)):
                    like[truth, i, v] = like.get((truth, i, v), 0.5) + w
        new = []
        for r in rows:
            odds = math.log(prior[1, r["kind"]] / prior[0, r["kind"]])
            for i, v in enumerate(votes_of(r)):
                part = [like.get((t, i, v), 0.5) / sum(like.get((t, i, x), 0.5) for x in (-1, 0, 1)) for t in (0, 1)]
                odds += math.log(part[1] / part[0])
            new.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        done = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0) < 1e-6
        post = new
        if done:
            break
    return post


def features(row: Row) -> list[float]:
    """An input for each kind and each labeler's vote."""
    return [1.0 * (row["kind"] == k) for k in KINDS] + [float(v) for v in votes_of(row)]


def logistic(rows: Sequence[Row], post: Sequence[float], rounds: int = 500, decay: float = 1e-3) -> list[float]:
    """Weights of the classifier on the rows' features, the posteriors as soft labels."""
    xs, total = [features(r) for r in rows], sum(r["n"] for r in rows)
    w = [0.0] * (len(KINDS) + len(LABELERS))
    for _ in range(rounds):
        slope = [decay * v for v in w]
        for r, x, p in zip(rows, xs, post, strict=True):
            z = sum(a * b for a, b in zip(w, x, strict=True))
            miss = (1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - p) * r["n"] / total
            for i, v in enumerate(x):
                slope[i] += miss * v
        w = [a - 1.0 * b for a, b in zip(w, slope, strict=True)]
    return w


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base, by kind and start) of each row of docs."""
    rows = materialize(candidates(docs), "pii-candidates")
    told = rows.select(F.explode(F.concat("base", "failed", "loose")).alias("c")).select("c.kind", *[f"c.{n}" for n in LABELERS])
    counts = told.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()
    added = F.filter("loose", lambda c: F.lit(False))
    if counts:
        w = logistic(counts, reliabilities(counts))
        kind_weight = F.array(*[F.lit(x) for x in w[:len(KINDS)]])
        added = F.filter("loose", lambda c: (F.get(kind_weight, c["rank"]) + sum(
            (F.lit(x) * c[n] for x, n in zip(w[len(KINDS):], LABELERS, strict=True)), F.lit(0.0)) > 0) & (c["check"] > 0)
            & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    spans = F.sort_array(F.transform(F.concat("base", added), lambda c: F.struct(
        c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))))
    return rows.select("doc_id", F.transform(spans, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))).alias("spans"))


def digest(found_: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256 and spans as one string."""
    base = F.filter("spans", lambda c: c["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found_.select(
        "doc_id", *map(number, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
