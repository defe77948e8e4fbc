"""Quality of documents by hierarchical empirical Bayes over sites.

A logistic classifier on surface measures of a text gives each document evidence: its log odds of
being good, less those of the sample it was fitted on. Sites give the prior: the classifier's
probabilities are summed up by host and by path (host and first part of the path), a host's rate
is shrunk toward the rate of all, a path's toward its host's, each with the strength that the
spread of the rates beyond chance implies. A sparse site so keeps the global prior and a large one
its own. A document's own part is taken out of its site's sums, so it isn't counted twice.
Posterior log odds are the evidence plus the log odds of the document's path.

The classifier is fitted on at most ``sample`` labelled documents, those with the smallest hash of
their id; all else sees every document. Sums are grouped aggregations; nothing else is shuffled.

Defined results: null or empty text has all measures 0; null hosts or paths are a site of their
own; labels of unknown documents are not used, null labels neither, repeated ones count once each;
without both kinds of label there is no evidence, and the prior alone decides; repeated rows are
documents of their own; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.llm import common
from corpuspack.session import materialize

#: Labelled documents that the classifier is fitted on at most.
SAMPLE = 20_000
#: Documents from this posterior on are kept.
THRESHOLD = 0.5

_CLASSES = ("upper", "digit", "mark", "symbol", "shout", "line")


def _class_tables() -> np.ndarray:
    """For each class of bytes a table of which bytes belong to it."""
    members = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b".,;:?", "symbol": b"#*$%&|<>{}[]\\^~=_@/",
               "shout": b"!", "line": b"\n"}
    tables = np.zeros((len(_CLASSES), 256), bool)
    for row, name in zip(tables, _CLASSES, strict=True):
        row[list(members[name])] = True
    return tables


_TABLES = _class_tables()
MEASURES = ("words", "word_length", *_CLASSES, "distinct_words", "distinct_triples", "longest_word")


def measures(column: pa.Array) -> np.ndarray:
    """One row of numbers of about unit size for each text."""
    data, at = common.text_bytes(column)
    hashes, start, end = common.word_hashes(data)
    first = np.searchsorted(start, at)
    n = np.diff(first)
    size = np.maximum(np.diff(at) - 1, 1)
    out = np.zeros((len(n), len(MEASURES)), np.float64)
    out[:, 0] = np.log1p(n) / 5
    length = np.concatenate(([0], np.cumsum(end - start)))
    out[:, 1] = (length[first[1:]] - length[first[:-1]]) / np.maximum(n, 1) / 5
    for k, table in enumerate(_TABLES):
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        out[:, 2 + k] = np.sqrt((sums[at[1:]] - sums[at[:-1]]) / size) * 3
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, text)) if len(text) else np.zeros(0, np.int64)
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    out[:, -3] = np.bincount(t[new], minlength=len(n)) / np.maximum(n, 1)
    _, border = common.shingle_sets(column, 3)
    out[:, -2] = np.diff(border) / np.maximum(n - 2, 1)
    full = n > 0
    if full.any():
        out[full, -1] = np.log1p(np.maximum.reduceat(end - start, first[:-1][full])) / 5
    out[~full] = 0
    return out


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and x (the measures) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=2 << 20):
            x = pa.array(measures(batch.column(1)).astype(np.float32).tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), x],
                                             names=["doc_id", "host", "path", "x"])

    def name(c: Column) -> Column:  # a null name is a name of its own
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), name(host).alias("host"),
                       name(path).alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, x array<float>")


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (last: constant) of a logistic classifier, by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), decay)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classifier(rows: DataFrame, labels: DataFrame, sample: int) -> tuple[list[float], float] | None:
    """Weights and the log odds of the sample; None without both kinds of label."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        "doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))  # even in [0, 1)
    known = materialize(rows.select("doc_id", "x").join(told, "doc_id").withColumn("place", place), "quality-labelled")
    # the smallest places are among those below twice the sample's share, so tasks send no more
    near = known.where(F.col("place") <= min(1.0, 2.0 * sample / max(1, known.count())))
    got = near.orderBy("place", "doc_id").limit(sample).toPandas()
    y = (got["y"].to_numpy() > 0).astype(float) if len(got) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return None
    w = fit(np.array(got["x"].tolist(), float), y)
    return [float(v) for v in w], float(np.log(y.mean() / (1 - y.mean())))


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, s: str, n: str, toward: str) -> Column:
    """How many documents a prior is worth, from how far the groups' rates s / n spread around
    their priors beyond chance (moments): few where groups differ, many where they don't; from 1
    to 10,000."""
    prior = F.col(toward)
    chance = prior * (1 - prior) + 1e-6
    got = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - prior) ** 2).alias("seen"),
                     F.sum(chance).alias("noise"), F.sum(F.col(n) * chance).alias("whole"))
    return got.select(F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("whole") / F.greatest(
        F.col("seen") - F.col("noise"), F.col("whole") / 1e4) - 1)).alias("k")).scalar()


def site_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
                 sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate (without the document), quality, kept."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    common.small_batches(docs.sparkSession)
    rows = materialize(measured(docs, host, path), "quality-measures")
    model = classifier(rows, labels, sample)
    evidence = F.lit(0.0)
    if model:
        weights, odds = model
        dot = sum((F.lit(w) * F.get("x", F.lit(i)) for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
        evidence = F.greatest(F.least(dot - odds, F.lit(20.0)), F.lit(-20.0))
    scored = rows.select("doc_id", "host", "path", evidence.alias("evidence")).withColumn(
        "p", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(model[1] if model else 0.0)))))

    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    overall = paths.agg((F.sum("s") / F.sum("n")).alias("mean")).scalar()
    hosts = materialize(hosts.withColumn("mean", overall), "quality-hosts")
    hosts = hosts.withColumn("k", strength(hosts, "host_s", "host_n", "mean"))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + F.col("k") * F.col("mean")) / (F.col("host_n") + F.col("k")))
    # one row per path, written out so that it is planned by its real size
    sites = materialize(paths.join(hosts, "host"), "quality-sites")
    sites = sites.withColumn("path_k", strength(sites, "s", "n", "host_rate"))

    joined = scored.join(sites, ["host", "path"])
    alone = (F.col("host_s") - F.col("p") + F.col("k") * F.col("mean")) / (F.col("host_n") - 1 + F.col("k"))
    joined = joined.withColumn("host_rate", alone)
    own = (F.col("s") - F.col("p") + F.col("path_k") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_k"))
    joined = joined.withColumn("path_rate", own)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_rate")))))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", quality.alias("quality")).withColumn(
        "kept", F.col("quality") >= threshold)
