"""Quality rules by host.

Every document is measured and tried against rules, each with a loose and a strict limit. Failures
of the strict limit are summed up by host, a host's rate is shrunk toward all hosts' with a beta
prior fitted to the rates themselves (moments over the hosts), and a host is suspect for a rule if its
shrunk rate is high, or surely above the corpus rate: if ``SURE`` posterior standard deviations
below it still are ``TIMES`` the rate of all documents. The verdict goes back to the documents: on a suspect host
the rule's strict limit counts, elsewhere the loose one. Base rules count everywhere.

Measures of a text, over words (runs of other than the six ASCII separators): n_words, word_chars
(code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (those equal to an
earlier line), n_repeat_words (words in windows of three words found twice or more, the first
included). Windows are compared by 64-bit hashes; in a text of a million words two different ones
meet with a chance of 3e-8.

Defined results: null or empty text has measures 0 and fails the base rules; null hosts are one
host; repeated rows count as often as they occur; other columns are carried or not read; an empty
table gives an empty table. Hosts may hold any share of the rows: only one row of sums per task
and host is shuffled. Everything is native.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm.common import SEPARATORS, words
from corpuspack.session import materialize

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``part`` is above limit % of ``whole``."""

    name: str
    part: str
    whole: str
    loose: int
    strict: int


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 5, 2),
    Rule("dup_lines", "n_dup_lines", "n_lines", 50, 30),
    Rule("repeats", "n_repeat_words", "n_words", 50, 30),
)
#: Base rules: fewest words, and most words in repeated windows (%).
MIN_WORDS, MAX_REPEATS = 50, 50
#: A host is suspect for a rule from this shrunk rate on, or where its lower bound, so many posterior
#: standard deviations below, is at so many times the corpus rate.
SUSPECT, SURE, TIMES = 0.5, 2, 1.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measured(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """row (the carried columns), host and the measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    word = rf"[^{SEPARATORS}]"
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("source").cast("string").alias("host"),
        words(F.col("text")).alias("w"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0).alias("lines"))
    n = F.size("w")
    window = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>"))
    step = step.select("row", "host", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       n.cast("long").alias("n_words"), window.alias("h"))
    # windows by hash and place, only where some hash occurs twice
    same = F.size(F.array_distinct("h")) == F.size("h")
    step = step.withColumn("s", F.when(~same, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("s", lambda x, i: (F.get("s", i + 1)["h"] == x["h"]).eqNullSafe(True) | (
        F.when(i > 0, F.get("s", i - 1)["h"]) == x["h"]).eqNullSafe(True))
    step = step.withColumn("t", F.transform(twice, lambda x: x["i"])).drop("h", "s")
    covered = F.size(F.array_distinct(F.concat(F.col("t"), F.transform("t", lambda x: x + 1), F.transform("t", lambda x: x + 2))))
    return step.withColumn("n_repeat_words", F.when(F.col("t").isNull(), 0).otherwise(covered).cast("long")).select(
        "row", "host", *MEASURES)


def above(rule: Rule, limit: int) -> Column:
    return 100 * F.col(rule.part) > limit * F.col(rule.whole)


def base_failed(min_words: int = MIN_WORDS, max_repeats: int = MAX_REPEATS) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words"))


def host_rates(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per host: n and for each rule its shrunk failure rate (posterior mean under the beta prior
    whose mean and strength match the hosts' rates), its posterior variance and the corpus rate."""
    hosts = materialize(rows.groupBy("host").agg(F.count("*").alias("n"), *[
        F.sum(above(r, r.strict).cast("long")).alias(r.name) for r in rules]), "host-sums")
    fits = []
    for r in rules:
        rate = F.col(r.name) / F.col("n")
        mean, var = F.sum(r.name) / F.sum("n"), F.coalesce(F.var_samp(rate), F.lit(0.0))
        # var = m (1 - m) / (strength + 1) + sampling noise, so the strength from what noise leaves
        noise = F.avg(1 / F.col("n"))
        spread = F.greatest(mean * (1 - mean), F.lit(1e-6))
        between = F.greatest(var - spread * noise, spread / 1e4)
        fits += [mean.alias(f"{r.name}_m"), F.greatest(spread / between - 1, F.lit(1.0)).alias(f"{r.name}_k")]
    prior = hosts.agg(*fits).select(F.struct("*")).scalar()  # one row
    shrunk = hosts.withColumn("prior", prior).select("*", *[
        ((F.col(r.name) + F.col(f"prior.{r.name}_m") * F.col(f"prior.{r.name}_k")) / (
            F.col("n") + F.col(f"prior.{r.name}_k"))).alias(f"{r.name}_rate") for r in rules])
    columns = []
    for r in rules:
        rate = F.col(f"{r.name}_rate")
        variance = rate * (1 - rate) / (F.col("n") + F.col(f"prior.{r.name}_k") + 1)
        columns += [rate, variance.alias(f"{r.name}_variance"), F.col(f"prior.{r.name}_m").alias(f"{r.name}_corpus")]
    return shrunk.select("host", "n", *columns)


def suspected(rule: Rule, suspect: float, sure: float, times: float) -> Column:
    """Whether a host of host_rates is suspect for a rule."""
    rate, corpus = F.col(f"{rule.name}_rate"), F.col(f"{rule.name}_corpus")
    return (rate >= suspect) | ((corpus > 0) & (rate - sure * F.sqrt(F.col(f"{rule.name}_variance")) >= times * corpus))


def judge(docs: DataFrame, carry: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES,
          suspect: float = SUSPECT, sure: float = SURE, times: float = TIMES) -> DataFrame:
    """Columns ``carry`` of docs (doc_id, text, source), the measures, base_failed, kept."""
    rows = materialize(measured(docs, carry), "host-rules")
    hosts = materialize(host_rates(rows, rules).select(
        F.coalesce("host", F.lit("")).alias("name"), F.col("host").isNull().alias("nameless"), *[
            suspected(r, suspect, sure, times).alias(f"{r.name}_suspect") for r in rules]), "host-verdicts")
    joined = rows.join(hosts, (F.coalesce(rows["host"], F.lit("")) == hosts["name"]) & (
        rows["host"].isNull() == hosts["nameless"]))
    failed = base_failed()
    for r in rules:
        failed = failed | above(r, r.loose) | (F.col(f"{r.name}_suspect") & above(r, r.strict))
    return joined.select("row.*", *MEASURES, base_failed().alias("base_failed"), (~failed).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = judge(docs.select("text", "source", row.alias("whole")), carry=["whole"])
    return judged.where("kept").select("whole.*")
