"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact check.

1. One pass makes of each text its set of distinct word shingles (64-bit hashes, ASCII letters
   lower-cased), the set's size, a 128-bit key and a MinHash signature. Documents with one key have
   one set; from here on a set stands for its documents, under a number of its own.
2. Sets that share a band (4 of 128 values, 32 bands) are candidates: two sets at the threshold of
   0.75 share no band with a chance of 5e-6.
3. Candidates are never all pairs of a bucket. Round one pairs each member of a bucket with the
   bucket's smallest set. Links found join sets to components. Only buckets that still hold
   several components go on: round two pairs their members with the one of most links so far. For
   the last round the buckets are cut into blocks, and tasks compare the signatures of two blocks
   at a time, members of one component excepted, so no link between components is missed and only
   pairs that the signatures don't rule out become rows, each in the first bucket it shares.
4. A pair's signatures are compared in batches; under a uniform prior the pair is dropped as soon
   as the posterior chance that its similarity reaches the threshold is below ``miss``. Survivors
   are checked exactly on the full sets. In the last round, in which most pairs are of middling
   similarity, three times as many further values are compared.

Defined results: null or empty text, or one without words, has an empty set and no link; null
doc_id has no link and no component, but is kept; rows with one doc_id and one set are one
document (``keep`` keeps one row of them), rows with one doc_id and different sets are different
documents, each judged by its own set; a component has the smallest doc_id of its sets; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.llm import common
from corpuspack.session import materialize

#: Sides of up to this many 8-byte ids (16 MB) are broadcast after they were counted.
BROADCAST_IDS = 2_000_000


#: Members of a bucket's block in the last round, and pairs compared at once.
BLOCK, PAIRS = 1024, 20_000
#: What tells sets apart.
SET = ["key1", "key2", "n_shingles"]
#: Further values of the last round for each of the first signature, kept in 16 bits.
FURTHER = 3


def factors(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers for the two halves of a hash, one pair for each MinHash function."""
    seeds = common.mix(np.arange(2 * first + 1, 2 * (first + count) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return odd[::2], odd[1::2]


def signatures(values: np.ndarray, border: np.ndarray, count: int, after: int = 0) -> np.ndarray:
    """MinHash signatures of the non-empty sets, one row each, by ``count`` functions from the
    ``after``-th on."""
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    first = border[:-1][np.diff(border) > 0]
    out = np.empty((len(first), count), "<u4")
    a, b = factors(after, count)
    for k in range(count):
        h = low * a[k]
        h ^= high * b[k]
        out[:, k] = np.minimum.reduceat(h, first) if len(first) else 0
    return out


def least_matches(batches: list[int], threshold: float, miss: float) -> list[int]:
    """For each number of compared values the fewest matches under which the chance of reaching
    the threshold is at least ``miss`` (a Beta(1 + matches, 1 + others) posterior's tail)."""
    out = []
    for n in batches:
        tail, need = 0.0, n + 1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out.append(need)
    return out


def set_keys(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Two independent hashes of each set (0 of an empty one)."""
    full = np.diff(border) > 0
    keys = np.zeros((2, len(full)), np.uint64)
    if full.any():
        first = border[:-1][full]
        keys[0, full] = np.add.reduceat(common.mix(values), first)
        keys[1, full] = np.bitwise_xor.reduceat(common.mix(values * np.uint64(0xD1342543DE82EF95)), first)
    return keys


def sketch(docs: DataFrame, n: int, count: int) -> DataFrame:
    """doc_id, n_shingles, key1, key2, signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            values, border = common.shingle_sets(batch.column(1), n)
            sizes = np.diff(border)
            full = sizes > 0
            keys = set_keys(values, border)
            made = iter(signatures(values, border, count))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys),
                pa.array([next(made).tobytes() if f else None for f in full], pa.binary())],
                names=["doc_id", "n_shingles", "key1", "key2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, key1 long, key2 long, signature binary")


def keyed(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, text, ...) with key1, key2 and n_shingles of each text, as ``sketch`` makes them."""
    kept = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            values, border = common.shingle_sets(batch.column(1), n)
            columns = [*set_keys(values, border).view(np.int64), np.diff(border)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)],
                                             names=[*kept, *SET])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in SET)])
    return rows.mapInArrow(run, schema)


def several_sets(sketches: DataFrame) -> DataFrame:
    """id: the doc_ids of rows with different sets, a written table."""
    of = F.struct(*SET)
    seen = sketches.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(of).alias("x"), F.max(of).alias("y"))
    return materialize(seen.where("x != y").select("id"), "several-sets")


def in_bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """band (64-bit key), no (of the band), id: a row for each set and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for k in range(rows):
                key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            ids, no = np.repeat(np.asarray(batch.column(0)), bands), np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(no), pa.array(ids)],
                                             names=["band", "no", "id"])

    return sets.select("id", "signature").mapInArrow(run, "band long, no int, id long")


def further(texts: DataFrame, n: int, count: int, after: int) -> DataFrame:
    """id and further signature values (16 bits each) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=1 << 20):
            made = signatures(*common.shingle_sets(batch.column(1), n), count, after).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in made], pa.binary())],
                                             names=["id", "more"])

    return texts.select("id", "text").mapInArrow(run, "id long, more binary")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows again, in tables that end where the first ``keys`` columns change."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        last = np.ones(table.num_rows, bool)
        for c in range(keys):
            last &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def across(members: DataFrame, bands: int, need: list[tuple[int, int]], first: int) -> DataFrame:
    """a, b of the pairs of members of a bucket that differ in component and that their signatures
    don't rule out, each pair in the first bucket that it shares.

    members: band, no, id, component, signature, more. ``need``: numbers of values compared and
    fewest matches, of which the first ``first`` values are the signature's.
    """
    counts = members.groupBy("band").agg(F.count("*").alias("n"))
    placed = members.join(counts, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "no", "id", "component",
        "signature", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            band, x, y, own, no, ids, component = (table.column(c).to_numpy() for c in range(7))
            sig = np.frombuffer(b"".join(table.column(7).to_pylist()), "<u4").reshape(len(ids), -1)
            more = np.frombuffer(b"".join(table.column(8).to_pylist()), "<u2").reshape(len(ids), -1)
            edge = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])

            def compared(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
                other = (component[left] != component[right]) & ((x[left] == y[left]) | (own[left] != own[right]))
                left, right = left[other], right[other]
                same = sig[left] == sig[right]
                shared = same.reshape(len(left), bands, -1).all(axis=2)
                here = shared.argmax(axis=1) == no[left]
                left, right, same = left[here], right[here], same[here]
                matches, seen = np.zeros(len(left), np.int64), 0
                for upto, least in need:
                    if upto <= first:
                        matches = matches + same[:, seen:upto].sum(axis=1)
                    else:
                        a, b = seen - first, upto - first
                        matches = matches + (more[left, a:b] == more[right, a:b]).sum(axis=1)
                    alive, seen = matches >= least, upto
                    left, right, matches, same = left[alive], right[alive], matches[alive], same[alive]
                ends = np.sort(np.stack((ids[left], ids[right])), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

            lefts, rights, waiting = [], [], 0
            for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                for row in range(a, b - 1):
                    lefts.append(np.full(b - row - 1, row))
                    rights.append(np.arange(row + 1, b))
                    waiting += b - row - 1
                    if waiting >= PAIRS:
                        yield compared(np.concatenate(lefts), np.concatenate(rights))
                        lefts, rights, waiting = [], [], 0
            if waiting:
                yield compared(np.concatenate(lefts), np.concatenate(rights))

    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(run, "a long, b long")


def likely(pairs: DataFrame, need: list[tuple[int, int]]) -> DataFrame:
    """a, b of the pairs (a, b, sig_a, sig_b) that no batch of values rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1)
                           for c in (2, 3))
            alive, matches, seen = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for upto, least in need:
                matches[alive] += (left[alive, seen:upto] == right[alive, seen:upto]).sum(axis=1)
                alive, seen = alive[matches[alive] >= least], upto
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))],
                                             names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, text_a, text_b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text=2, limit=1 << 20):
            values, pair, total = [], [], 0
            for c in (2, 3):
                v, border = common.shingle_sets(batch.column(c), n)
                values.append(v)
                pair.append(np.repeat(np.arange(batch.num_rows), np.diff(border)))
                total = total + np.diff(border)
            v, p = np.concatenate(values), np.concatenate(pair)
            order = np.lexsort((v, p))
            v, p = v[order], p[order]
            shared = np.bincount(p[1:][(v[1:] == v[:-1]) & (p[1:] == p[:-1])], minlength=batch.num_rows)
            good = pa.array(100 * shared >= percent * (total - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has few enough rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of the ends of links (a, b), a written table.

    Smallest label of the neighbours, then label of the label, until nothing changes: the rounds
    grow with the logarithm of the longest path.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "m").alias("component"))
        up = lower.select(F.col("id").alias("via"), F.col("component").alias("root"))
        jumped = lower.join(up, lower["component"] == up["via"]).select("id", F.col("root").alias("component"))
        new = materialize(jumped, "labels")
        old = labels.select(F.col("id").alias("i"), F.col("component").alias("c"))
        changed = new.join(old, (new["id"] == old["i"]) & (new["component"] != old["c"]))
        labels = new
        if changed.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, batch: int = 32,
                    miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return judged(docs, n, percent, bands, rows, batch, miss)[0].drop("key1", "key2")


def judged(docs: DataFrame, n: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, batch: int = 32,
           miss: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """What ``near_duplicates`` returns, with key1 and key2, and the doc_ids (id) with several sets."""
    common.small_batches(docs.sparkSession)
    count = bands * rows
    sketches = materialize(sketch(docs, n, count), "sketches")
    several = several_sets(sketches)
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    sets = materialize(usable.groupBy(*SET).agg(
        F.min("doc_id").alias("doc"), F.first("signature").alias("signature")).orderBy("doc", *SET).withColumn(
        "id", F.monotonically_increasing_id()), "sets")  # numbers rise with doc_id: the oldest is the hub

    banded = in_bands(sets, bands, rows)
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialize(banded.join(shared, "band"), "band-members")
    candidates = materialize(members.select("id").distinct(), "candidates")
    few = small(candidates)
    signed = materialize(sets.join(few, "id").select("id", "signature"), "candidate-signatures")
    wanted = materialize(sets.join(few, "id").select("id", F.col("doc").alias("doc_id"), *SET), "candidate-sets")
    written = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).join(
        small(materialize(wanted.select(F.col("doc_id").alias("id")).distinct(), "candidate-docs")), "id")
    mixed = not several.isEmpty()
    single = written.join(small(several), "id", "left_anti") if mixed else written
    texts = single.withColumnRenamed("id", "doc_id").join(wanted.drop(*SET), "doc_id").select("id", "text")
    if mixed:  # the text with the set's own keys
        other = keyed(written.join(small(several), "id", "left_semi").select("id", "text"), n)
        texts = texts.union(other.withColumnRenamed("id", "doc_id").join(wanted, ["doc_id", *SET]).select("id", "text"))
    texts = materialize(texts.dropDuplicates(["id"]), "candidate-texts")
    steps = list(range(batch, count * (1 + FURTHER) + 1, batch))
    bounds = list(zip(steps, least_matches(steps, percent / 100, miss), strict=True))
    need = [b for b in bounds if b[0] <= count]

    def ends(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left, right = (table.select(F.col("id").alias(c), F.col(column).alias(f"of_{c}")) for c in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")

    def check(pairs: DataFrame) -> DataFrame:
        return materialize(confirmed(ends(pairs, texts, "text"), n, percent), "links")

    def verify(pairs: DataFrame) -> DataFrame:
        return check(materialize(likely(ends(pairs, signed, "signature"), need), "likely"))

    def still_open(links: DataFrame) -> DataFrame:
        """Members, with their components, of the buckets that hold several."""
        placed = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
        return materialize(placed.join(mixed.select("band"), "band").select("band", "no", "id", "component"), "open-buckets")

    hubs = members.groupBy("band").agg(F.min("id").alias("a"))
    links = verify(members.join(hubs, "band").where("id != a").select("a", F.col("id").alias("b")).distinct())
    left = still_open(links)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
    ranked = left.join(degree, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    best = ranked.groupBy("band").agg(F.max(F.struct("links", (-F.col("id")).alias("minus"), "component")).alias("best"))
    pairs = left.join(best, "band").where("component != best.component").select("id", (-F.col("best.minus")).alias("hub"))
    links = links.union(verify(pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()))
    left = still_open(links)
    chosen = texts.join(small(materialize(left.select("id").distinct(), "open")), "id")
    values = materialize(signed.join(further(chosen, n, FURTHER * count, count), "id"), "open-signatures")
    links = links.union(check(materialize(across(left.join(values, "id"), bands, bounds, count), "likely")))
    found = components(links)

    placed = materialize(sets.join(found, "id", "left").select(*SET, "doc", F.coalesce("component", "id").alias("component")), "placed-sets")
    heads = placed.groupBy("component").agg(F.min("doc").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    of_set = materialize(placed.join(heads, "component", "left").select(*SET, F.coalesce("of", "doc").alias("of")), "set-components")
    joined = sketches.drop("signature").join(of_set, SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id")
    return joined.select("doc_id", "n_shingles", component, "key1", "key2").withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(
        "doc_id", "n_shingles", "component_id", "kept", "key1", "key2"), several


def keep(docs: DataFrame, n: int = 5, **settings) -> DataFrame:
    """One document of each component: the rows of docs with the smallest doc_id, one of those
    with the same doc_id and set."""
    found, several = judged(docs, n, **settings)
    verdicts = materialize(found, "near-duplicates")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    kept, mixed = rows, None
    if not several.isEmpty():
        few = small(several)
        kept = rows.join(few, "id", "left_anti")
        stay = verdicts.join(few.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").where("kept").select(
            F.col("doc_id").alias("id"), *SET).distinct()
        mixed = keyed(rows.join(few, "id", "left_semi").select("id", "text", "whole"), n).join(stay, ["id", *SET]).dropDuplicates(["id", *SET])
        verdicts = materialize(verdicts.join(few.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti"), "single-sets")
    gone = materialize(verdicts.where("not kept").select(F.col("doc_id").alias("id")).distinct(), "dropped")
    kept = kept.drop("text").join(small(gone), "id", "left_anti")
    repeated = materialize(verdicts.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).count()
                           .where("count > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        twice = kept.join(small(repeated), "id", "left_semi").dropDuplicates(["id"])
        kept = kept.join(small(repeated), "id", "left_anti").union(twice)
    kept = kept.select("whole")
    return (kept.union(mixed.select("whole")) if mixed is not None else kept).select("whole.*")
