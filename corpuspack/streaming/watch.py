"""Change feeds: filter, throttle, last change, snapshot diff and incremental rebuilds.

A change feed is a ``change_events(event_id, ts, root, path, kind, is_directory)`` table
or stream. Filters are stateless ``where`` clauses written before the stateful step (they
must run first: a dropped event does not use up a throttle window). The throttle keeps an
event when at least ``gap`` has passed since the last *kept* event of the same root; it is
keyed by root, so different roots run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from corpuspack.functions import paths as P
from corpuspack.functions.times import epoch_micros
from corpuspack.functions.patterns import keyword_filter

# Fixed value: the watcher's minimum gap between two accepted changes.
DEFAULT_GAP_SECONDS = 0.5


def watch_filter(events: DataFrame, extension: str | None = None, ignore_names: Sequence[str] = (),
                 ignore_paths: Sequence[str] = (), include_names: Sequence[str] = ()) -> DataFrame:
    """Drop directory events, other suffixes (``None`` = all), ignored and not-included files.

    ``path`` is normalised to '/' separators and is relative to the watched root.
    """
    p = P.normalize_separators(F.col("path"))
    df = events.where(~F.col("is_directory")).withColumn("path", p)
    if extension is not None:
        df = df.where(F.col("path").endswith(extension))
    return df.where(keyword_filter(P.base_name(F.col("path")), F.col("path"), ignore_names, ignore_paths, include_names))


def _micros(df: DataFrame, ts_col: str):
    return epoch_micros(df, ts_col)


def _accept_run(t: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Greedy leading-edge throttle over one key's sorted times: jump straight to the
    first time >= last + gap with a binary search (cost ~ kept events x log n)."""
    kept: list[int] = []
    n = len(t)
    i = 0
    if gap <= 0:
        return list(range(n)), (int(t[-1]) if n else last)
    if last is not None:
        i = int(np.searchsorted(t, last + gap, side="left"))
    while i < n:
        kept.append(i)
        last = int(t[i])
        i = int(np.searchsorted(t, last + gap, side="left"))
    return kept, last


def _changes(k: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before; NULL equals NULL."""
    one, two = k.slice(1), k.slice(0, len(k) - 1)
    both_null = pc.and_(pc.is_null(one), pc.is_null(two))
    return pc.if_else(both_null, False, pc.not_equal(one, two).fill_null(True)).to_numpy(zero_copy_only=False)


def _scan(key: str, gap: int):
    def run(batches):
        carry_key, carry_last = None, None
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            kcol = b.column(key)
            t = b.column("_t").to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = [0]
            if n > 1:
                bounds += (np.flatnonzero(_changes(kcol)) + 1).tolist()
            bounds.append(n)
            take: list[int] = []
            for s, e in zip(bounds[:-1], bounds[1:]):  # one run per key
                k = kcol[s].as_py()
                last = carry_last if k == carry_key else None
                kept, last = _accept_run(t[s:e], last, gap)
                take.extend(s + j for j in kept)
                carry_key, carry_last = k, last
            if take:
                yield b.take(pa.array(take, type=pa.int64()))

    return run


# roots with more change rows than this take the parallel (jump) path in method="auto"
HOT_ROOT_ROWS = 2_000_000


def _throttle_scan(df: DataFrame, key: str, gap: int, tiebreak: str) -> DataFrame:
    parted = df.repartition(key).sortWithinPartitions(key, "_t", tiebreak)
    return parted.mapInArrow(_scan(key, gap), df.schema)


def _next_pointers(ev: DataFrame, key: str, gap: int, tiebreak: str, num_ranges: int) -> DataFrame:
    """``(_id, _nxt)``: for each event the first event of its key at time >= t + gap.

    Probes (t + gap) and events are range-partitioned together on (key, time, tag), so a
    hot key spreads over many ranges; one forward pass per range hands each probe the next
    event. Probes still open at the end of a range take the first event of the next range
    holding one for that key (a table of at most ranges x keys-per-range rows)."""
    from corpuspack.session import materialize

    targets = ev.select(key, F.col("_t").alias("_time"), F.lit(1).alias("_tag"), F.col("_id"), F.col(tiebreak).alias("_tb"))
    probes = ev.select(key, (F.col("_t") + F.lit(gap)).alias("_time"), F.lit(0).alias("_tag"), F.col("_id"),
                       F.lit(None).cast("long").alias("_tb"))
    both = targets.unionByName(probes).repartitionByRange(num_ranges, key, "_time", "_tag", "_tb") \
        .sortWithinPartitions(key, "_time", "_tag", "_tb")
    out_schema = T.StructType([
        T.StructField(key, ev.schema[key].dataType), T.StructField("_id", T.LongType()),
        T.StructField("_nxt", T.LongType()), T.StructField("_range", T.IntegerType()),
        T.StructField("_first", T.BooleanType()),
    ])

    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [key, "_id", "_nxt", "_range", "_first"]
        before, carry_key, carry_has, pending = False, None, False, np.empty(0, dtype=np.int64)

        def out(keys, ids, nxt, first):
            m = len(ids)
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(ids, pa.int64()), pa.array(nxt, pa.int64(), mask=None if nxt is None else nxt < 0)
                 if nxt is not None else pa.nulls(m, pa.int64()),
                 pa.array(np.full(m, part, dtype=np.int32)), pa.array(np.full(m, first))], names=names)

        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            k = b.column(key)
            key_type = k.type
            tag = b.column("_tag").to_numpy(zero_copy_only=False)
            ids = b.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.zeros(n, dtype=bool)
            starts[0] = True
            if n > 1:
                starts[1:] = _changes(k)
            run = np.cumsum(starts) - 1
            run_starts = np.flatnonzero(starts)
            n_runs = len(run_starts)
            idx = np.arange(n)
            # index of the first event at or after each row (n when none)
            nxt_any = np.minimum.accumulate(np.where(tag == 1, idx, n)[::-1])[::-1]
            in_run = (nxt_any < n) & (run[np.minimum(nxt_any, n - 1)] == run)
            continues = before and k[0].as_py() == carry_key
            # probes carried from the previous batch
            if len(pending):
                j = nxt_any[0]
                if continues and j < n and run[j] == 0:
                    yield out(pa.array([carry_key] * len(pending), k.type), pending,
                              np.full(len(pending), ids[j], dtype=np.int64), False)
                    pending = np.empty(0, dtype=np.int64)
                elif not (continues and n_runs == 1):
                    yield out(pa.array([carry_key] * len(pending), k.type), pending, None, False)
                    pending = np.empty(0, dtype=np.int64)
            probe = tag == 0
            hit = np.flatnonzero(probe & in_run)
            if len(hit):
                yield out(k.take(pa.array(hit)), ids[hit], ids[nxt_any[hit]], False)
            last = run == n_runs - 1
            closed = np.flatnonzero(probe & ~in_run & ~last)
            if len(closed):
                yield out(k.take(pa.array(closed)), ids[closed], None, False)
            pending = np.concatenate([pending, ids[probe & ~in_run & last]])
            # first event of each key in this range
            ft = nxt_any[run_starts]
            has = (ft < n) & (run[np.minimum(ft, n - 1)] == np.arange(n_runs))
            first_mask = has.copy()
            if continues and carry_has:
                first_mask[0] = False
            fi = ft[first_mask]
            if len(fi):
                yield out(k.take(pa.array(fi)), ids[fi], None, True)
            carry_has = bool(has[-1]) or (n_runs == 1 and continues and carry_has)
            before, carry_key = True, k[n - 1].as_py()
        if len(pending):
            yield out(pa.array([carry_key] * len(pending), key_type), pending, None, False)

    local = materialize(both.mapInArrow(scan, out_schema), "throttle-nxt")
    # per (key, range): the first event of the key in any later range (<= ranges + keys rows)
    pairs = local.select(key, "_range").distinct()
    firsts = local.where("_first").select(key, "_range", F.col("_id").alias("_fid"))
    w = Window.partitionBy(key).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.withColumnsRenamed({key: "_key1", "_range": "_range1"})
    later = pairs.join(firsts, F.col(key).eqNullSafe(F.col("_key1")) & (F.col("_range") == F.col("_range1")), "left").select(
        key, "_range", F.first("_fid", ignorenulls=True).over(w).alias("_later"))
    later = later.withColumnsRenamed({key: "_key0", "_range": "_range0"})
    same = F.col(key).eqNullSafe(F.col("_key0")) & (F.col("_range") == F.col("_range0"))
    answered = local.where(~F.col("_first") & F.col("_nxt").isNotNull()).select("_id", "_nxt")
    opened = local.where(~F.col("_first") & F.col("_nxt").isNull()).join(later, same).select(
        "_id", F.col("_later").alias("_nxt"))
    return answered.unionByName(opened)


def _throttle_jump(df: DataFrame, key: str, gap: int, tiebreak: str, num_ranges: int) -> DataFrame:
    """Exact throttle without a sequential pass: kept events are the orbit of each key's
    first event under ``nxt``; pointer doubling (J_{k+1} = J_k o J_k, equi-joins on event
    id) reaches every orbit member in log2(orbit length) rounds."""
    from corpuspack.session import materialize

    ev = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "throttle-ev")
    jumps = [materialize(_next_pointers(ev, key, gap, tiebreak, num_ranges).where(F.col("_nxt").isNotNull()),
                         "throttle-j0")]
    while not jumps[-1].isEmpty():
        j = jumps[-1]
        nxt = j.alias("a").join(j.alias("b"), F.col("a._nxt") == F.col("b._id")).select(
            F.col("a._id").alias("_id"), F.col("b._nxt").alias("_nxt"))
        jumps.append(materialize(nxt, f"throttle-j{len(jumps)}"))
    start = ev.groupBy(key).agg(F.min_by("_id", F.struct("_t", tiebreak)).alias("_id")).select("_id")
    orbit = start
    for j in reversed(jumps):
        step = orbit.join(j, "_id").select(F.col("_nxt").alias("_id"))
        orbit = materialize(orbit.unionByName(step).distinct(), "throttle-orbit")
    return ev.join(orbit, "_id", "left_semi").drop("_id")


def throttle(events: DataFrame, gap_seconds: float = DEFAULT_GAP_SECONDS, key: str = "root",
             ts: str = "ts", tiebreak: str = "event_id", method: str = "auto",
             hot_rows: int = HOT_ROOT_ROWS) -> DataFrame:
    """Batch throttle: rows kept by the leading-edge rule, per ``key`` in time order.

    ``scan``: hash-partition by key, sort by (key, time, tiebreak) and scan each partition
    once with the kept time carried across Arrow batches (one shuffle, bounded memory, but
    a key is scanned by one task). ``jump``: the exact parallel form (range partitions and
    pointer doubling) that splits a hot key over many tasks. ``auto``: keys with more than
    ``hot_rows`` rows go the ``jump`` way, the rest the ``scan`` way.
    """
    gap = int(round(gap_seconds * 1_000_000))
    df = events.withColumn("_t", _micros(events, ts))
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if gap <= 0:
        return events
    if method == "scan":
        return _throttle_scan(df, key, gap, tiebreak).drop("_t")
    if method == "jump":
        return _throttle_jump(df, key, gap, tiebreak, n).drop("_t")
    from corpuspack.session import materialize

    hot = materialize(df.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > hot_rows).select("_hot"), "hot-keys")
    if hot.isEmpty():
        return _throttle_scan(df, key, gap, tiebreak).drop("_t")
    same = F.col(key).eqNullSafe(F.col("_hot"))
    cold = _throttle_scan(df.join(hot, same, "left_anti"), key, gap, tiebreak)
    warm = _throttle_jump(df.join(hot, same, "left_semi"), key, gap, tiebreak, n)
    return cold.unionByName(warm).drop("_t")


def last_changed(kept: DataFrame, key: str = "root", ts: str = "ts") -> DataFrame:
    """Last accepted change per key (latest time, then highest event id)."""
    return kept.groupBy(key).agg(
        F.max_by("path", F.struct(F.col(ts), F.col("event_id"))).alias("last_path"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_kept"),
    )


# ---------------------------------------------------------------------------------------
# streaming


def _state_fn(gap: int):
    def fn(key, pdfs, state):
        last = state.get[0] if state.exists else None
        # rows that the last kept one already rules out are dropped chunk by chunk
        frames = [p if last is None or gap <= 0 else p[p["_t"] >= last + gap] for p in pdfs]
        frames = [p for p in frames if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["_t", "event_id"], kind="stable")
        t = pdf["_t"].to_numpy(dtype=np.int64)
        kept, last = _accept_run(t, last, gap)
        if last is not None:
            state.update((int(last),))
        if kept:
            yield pdf.iloc[kept].drop(columns=["_t"])

    return fn


def throttle_stream(events: DataFrame, gap_seconds: float = DEFAULT_GAP_SECONDS, key: str = "root",
                    ts: str = "ts") -> DataFrame:
    """Streaming throttle with per-key state (the last kept time) across micro-batches.

    Within a micro-batch rows are taken in time order; a row older than the key's last
    kept time is dropped. Feed the stream in time order for replay equality with
    :func:`throttle`.
    """
    gap = int(round(gap_seconds * 1_000_000))
    df = events.withColumn("_t", _micros(events, ts))
    out_schema = T.StructType([f for f in df.schema.fields if f.name != "_t"])
    state_schema = T.StructType([T.StructField("last", T.LongType())])
    return df.groupBy(key).applyInPandasWithState(
        _state_fn(gap), out_schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


class BatchThrottle:
    """Throttle of a stream's micro-batches, with each key's last kept time in a table.

    Rows that a last kept time rules out are dropped; of what is left the first row of each key is
    kept, as in a feed that begins there, so the batch form (:func:`throttle`) decides: a key with many
    rows is spread over tasks. The times are a log of changes (:class:`DeltaLog`) under ``state_dir``, one
    version per micro-batch; one that runs again starts from the times before it.
    """

    def __init__(self, state_dir: str, gap_seconds: float = DEFAULT_GAP_SECONDS, key: str = "root", ts: str = "ts",
                 tiebreak: str = "event_id", hot_rows: int = HOT_ROOT_ROWS):
        self.state_dir, self.gap, self.key, self.ts, self.tiebreak = state_dir.rstrip("/"), gap_seconds, key, ts, tiebreak
        self.hot_rows = hot_rows

    def __call__(self, rows: DataFrame, batch_id: int) -> DataFrame:
        from corpuspack.operators.deltalog import DeltaLog
        from corpuspack.session import materialize

        gap = int(round(self.gap * 1_000_000))
        if gap <= 0:
            return rows
        log = DeltaLog(rows.sparkSession, self.state_dir, ["k"], "k string, last long")
        if log.last() is None:
            log.start(rows.sparkSession.createDataFrame([], "k string, last long"))
        last = log.current(before=batch_id)
        timed = rows.withColumns({"_k": F.col(self.key).cast("string"), "_at": _micros(rows, self.ts)})
        open_ = timed.join(last, F.col("_k").eqNullSafe(F.col("k")), "left").where(
            F.col("last").isNull() | (F.col("_at") >= F.col("last") + gap)).drop("k", "last")
        kept = materialize(throttle(open_, self.gap, "_k", self.ts, self.tiebreak, hot_rows=self.hot_rows), "throttle-kept")
        log.append(batch_id, kept.groupBy(F.col("_k").alias("k")).agg(F.max("_at").alias("last")).withColumn("gone", F.lit(False)))
        return kept.drop("_k", "_at")


def throttle_feed(events: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, gap_seconds: float = DEFAULT_GAP_SECONDS,
                  key: str = "root", ts: str = "ts", trigger: dict | None = None, hot_rows: int = HOT_ROOT_ROWS):
    """Run a stream of changes through :class:`BatchThrottle`; ``sink(kept, batch_id)`` gets the kept
    rows of each micro-batch. State and checkpoint lie under ``folder``. Returns the running query."""
    from corpuspack.session import materialize

    keep = BatchThrottle(f"{folder}/last-kept", gap_seconds, key, ts, hot_rows=hot_rows)

    def each(rows: DataFrame, batch_id: int) -> None:  # written once, as it would be computed for every use
        sink(keep(materialize(rows, "throttle-batch"), batch_id), batch_id)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def watch(events: DataFrame, callback: Callable[[DataFrame, int], None], *, extension: str | None = None,
          ignore_names: Sequence[str] = (), ignore_paths: Sequence[str] = (), include_names: Sequence[str] = (),
          gap_seconds: float = DEFAULT_GAP_SECONDS, checkpoint: str, trigger: dict | None = None, coalesce: bool = False):
    """Filter -> throttle -> ``callback(kept_changes_df, batch_id)`` per micro-batch.

    Returns the running ``StreamingQuery``: it goes on until ``.stop()``, looking for changes
    every second, unless ``trigger`` says otherwise (``{"availableNow": True}`` ends with what
    is there). With the same ``checkpoint`` it resumes where it stopped.

    ``coalesce``: no change is dropped; the callback gets all different changed files of a
    micro-batch (their last change), at most one micro-batch per ``gap_seconds``. For callbacks
    that act on the files that changed, and for feeds whose changes share one time, as polled ones do.
    """
    filtered = watch_filter(events, extension, ignore_names, ignore_paths, include_names)
    if coalesce:
        def each(rows: DataFrame, batch_id: int) -> None:
            from corpuspack.session import materialize

            names = rows.columns
            latest = rows.groupBy("root", "path").agg(F.max_by(F.struct(*names), F.struct("ts", "event_id")).alias("r"))
            callback(materialize(latest.select("r.*"), "changes"), batch_id)

        trigger = trigger or {"processingTime": f"{max(1, round(gap_seconds * 1000))} milliseconds"}
        return filtered.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    kept = throttle_stream(filtered, gap_seconds)
    writer = kept.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "1 second"}))
    return writer.start()


# ---------------------------------------------------------------------------------------
# snapshots


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, kind)`` with kind created / deleted / modified between two listings
    ``(path, content_hash)``."""
    a = before.select("path", F.col("content_hash").alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select("path", F.col("content_hash").alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, "path", "full")
    kind = (  # the side that is missing tells, as a hash may be NULL
        F.when(F.col("_in_a").isNull(), F.lit("created"))
        .when(F.col("_in_b").isNull(), F.lit("deleted"))
        .when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("modified"))
    )
    return j.select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


# ---------------------------------------------------------------------------------------
# incremental rebuild


class BundleRebuilder:
    """``foreachBatch`` handler: after each micro-batch of kept changes, refresh the
    selection against the current file table and rebuild only the bundles that hold a
    changed file that was selected, overwriting just their partitions of ``out_dir``.

    ``files_fn`` returns the current ``files(bundle, path, content)`` table. The selection
    lives in the shared folder as a table, so a restarted query picks it up; every write is
    a whole-partition overwrite, so a retried batch gives the same output.
    """

    def __init__(self, files_fn, selection: DataFrame, out_dir: str, state_dir: str, *, hide=(),
                 remove_comments: bool = False, remove_docstrings: bool = False):
        self.files_fn = files_fn
        self.out_dir = out_dir
        self.state_dir = state_dir.rstrip("/")
        self.hide = list(hide)
        self.rc, self.rd = remove_comments, remove_docstrings
        self.rebuilt: list[int] = []  # batches that rebuilt bundles, in this run
        log = self._log(selection.sparkSession)
        if log.last() is None:  # a first start; else the state goes on
            log.start(selection.select("path").distinct())

    def _log(self, spark):
        from corpuspack.operators.deltalog import DeltaLog

        return DeltaLog(spark, f"{self.state_dir}/selection", ["path"], "path string")

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.state_dir}/{table}/v{batch_id + 1:012d}"

    def current_selection(self, spark, before: int | None = None) -> DataFrame:
        """The latest selection, or the latest of before a batch."""
        return self._log(spark).current(before)

    def _refresh(self, files: DataFrame, old: DataFrame, batch_id: int) -> None:
        """Selected files that are gone leave the selection; only these are written."""
        from corpuspack.operators import selection as S

        there = S.visible_files(files, self.hide).select("path")
        self._log(files.sparkSession).append(batch_id, old.join(there, "path", "left_anti").withColumn("gone", F.lit(True)))

    def rebuilt_bundles(self, spark) -> DataFrame:
        """``(bundle, batch)`` of every rebuild that the state folder tells of."""
        return spark.read.schema("bundle string, batch long").parquet(f"{self.state_dir}/rebuilt/*")

    def _write(self, files: DataFrame, selection: DataFrame, bundles: DataFrame | None = None) -> None:
        from corpuspack.operators import bundle as B
        from corpuspack.operators import selection as S

        def chosen(rows: DataFrame) -> DataFrame:
            kept = S.keep_selected(S.visible_files(rows, self.hide), selection)
            return kept if bundles is None else kept.join(bundles, "bundle", "left_semi")

        blocks = B.pack(chosen(files), remove_comments=self.rc, remove_docstrings=self.rd)
        B.write_bundles(blocks, self.out_dir, only_written=True, keys=B.file_keys(chosen(files.select("bundle", "path"))))

    def build_all(self, spark) -> None:
        """Build every bundle of the current selection once (before the watch starts, when
        no confirmation is wanted)."""
        sel = self.current_selection(spark)
        if not sel.isEmpty():
            self._write(self.files_fn(), sel)

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        files = self.files_fn()
        old = self.current_selection(spark, before=batch_id)
        # membership is tested against the selection before the refresh, and the bundle is
        # the event's root, so the bundle of a deleted selected file is rebuilt too; written
        # once, as the micro-batch would be computed again for every use
        hit = changes.select("path", F.col("root").alias("bundle")).join(old, "path", "left_semi").select("bundle").distinct()
        hit.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(self._path("rebuilt", batch_id))
        hit = spark.read.schema("bundle string, batch long").parquet(self._path("rebuilt", batch_id)).select("bundle")
        self._refresh(files, old, batch_id)
        sel = self.current_selection(spark)
        if hit.isEmpty() or sel.isEmpty():
            return
        self._write(files, sel, hit)
        self.rebuilt.append(batch_id)


class PartRebuilder(BundleRebuilder):
    """A rebuilder over a :class:`PartStore` in ``out_dir``: a micro-batch rewrites the parts that hold
    its changed files that are or were selected, not their bundles. It must be told of every change,
    so it is run by ``watch(..., coalesce=True)``. With a ``select`` (a function of visible files) files
    that come up and match join the selection.
    """

    def __init__(self, files_fn, selection: DataFrame, out_dir: str, state_dir: str, *, select=None, files_per_part: int = 10_000, **kw):
        super().__init__(files_fn, selection, out_dir, state_dir, **kw)
        self.select, self.files_per_part = select, files_per_part

    def store(self, spark):
        from corpuspack.operators.partstore import PartStore

        return PartStore(spark, self.out_dir, files_per_part=self.files_per_part, remove_comments=self.rc, remove_docstrings=self.rd)

    def _chosen(self, files: DataFrame, selection: DataFrame) -> DataFrame:
        from corpuspack.operators import selection as S

        return S.keep_selected(S.visible_files(files, self.hide), selection)

    def build_all(self, spark) -> None:
        sel = self.current_selection(spark)
        if not sel.isEmpty():
            self.store(spark).build(self._chosen(self.files_fn(), sel))

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        from corpuspack.operators import selection as S
        from corpuspack.session import materialize

        spark = changes.sparkSession
        files, old = self.files_fn(), self.current_selection(spark, before=batch_id)
        # only the changed paths are looked up: what is gone leaves the selection, what matches enters
        named = materialize(changes.select(F.col("root").alias("bundle"), "path").distinct(), "changed")
        there = S.visible_files(files, self.hide).select("bundle", "path").join(named.select("path"), "path", "left_semi")
        there = materialize(there, "changed-files")
        was = old.join(named.select("path").distinct(), "path", "left_semi").withColumn("_was", F.lit(True))
        now = there.select("path").withColumn("_there", F.lit(True))
        fits = (self.select(there) if self.select else there.where(F.lit(False))).select("path").withColumn("_fits", F.lit(True))
        told = materialize(named.join(was, "path", "left").join(now.distinct(), "path", "left").join(fits.distinct(), "path", "left").select(
            "bundle", "path", F.coalesce("_was", F.lit(False)).alias("was"),
            (F.col("_there").isNotNull() & (F.col("_was").isNotNull() | F.col("_fits").isNotNull())).alias("is")), "changed-selection")
        delta = told.where(F.col("was") != F.col("is")).select("path", (~F.col("is")).alias("gone")).distinct()
        self._log(spark).append(batch_id, delta)
        hit = told.where(F.col("was") | F.col("is"))
        sel = self.current_selection(spark)
        if hit.isEmpty() or sel.isEmpty():
            return
        # a file's bundle is the one it lies in; of a file that is gone it is the event's root
        mine = there.select(F.col("bundle").alias("_b"), F.col("path").alias("_p"))
        hit = hit.join(mine, F.col("path") == F.col("_p"), "left").select(F.when(F.col("_p").isNotNull(), F.col("_b")).otherwise(F.col("bundle")).alias("bundle"), "path")
        if self.store(spark).update(self._chosen(files, sel), materialize(hit, "changed-hit"), batch_id):
            self.rebuilt.append(batch_id)


def replay_source(events: DataFrame, folder: str, chunks: int = 4, ts: str = "ts", rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Write a change table as time-ordered files under ``folder``, oldest first, and return a
    streaming reader over them, one file per trigger: a replay of the feed in arrival order.

    One range-partitioned write makes ``chunks`` files, or more so that one holds about
    ``rows_per_chunk`` rows; equal times are in one file. A file stream goes by the files' times, so
    these are set in the order of the ranges.
    """
    import time

    spark = events.sparkSession
    chunks = max(chunks, -(-events.count() // rows_per_chunk))
    place = f"{folder}/replay"
    events.repartitionByRange(chunks, ts).sortWithinPartitions(ts).write.mode("overwrite").parquet(place)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    begin = int(time.time() - len(parts)) * 1000
    for k, part in enumerate(parts):  # a file per million rows
        fs.setTimes(part, begin + 1000 * k, -1)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(place)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream until its input is consumed (``availableNow``) into a parquet table."""
    q = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


# ---------------------------------------------------------------------------------------
# polling a directory tree


def tree_snapshot(spark, root: str, by: str = "content", hide: Sequence[str] = ()) -> DataFrame:
    """``(path, content_hash)`` of every file under ``root``, computed on executors.

    ``by="content"`` hashes the bytes (exact); ``by="stat"`` uses size and modification
    time only, so a poll of a large tree reads no file contents.
    """
    from corpuspack.sources.tree import list_tree

    if by == "stat":
        listed = list_tree(spark, root, read_content=False, hide=hide).where(~F.col("is_dir"))
        sig = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("mtime").cast("string"))
        return listed.select("path", F.md5(sig).alias("content_hash"))
    return list_tree(spark, root, hide=hide).where(~F.col("is_dir")).select(
        "path", F.md5(F.coalesce(F.col("content"), F.lit(b""))).alias("content_hash"))


def snapshot_changes(before: DataFrame, after: DataFrame, root_name: str, at=None) -> DataFrame:
    """Rows in the ``change_events`` schema for the differences between two snapshots, so a
    polled directory feeds the same filter -> throttle -> rebuild path as an event feed."""
    diff = snapshot_diff(before, after)
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return diff.select(
        F.xxhash64("path", "kind").alias("event_id"), ts.alias("ts"), F.lit(root_name).alias("root"), "path",
        F.when(F.col("kind") == "modified", F.lit("modified")).otherwise(F.col("kind")).alias("kind"),
        F.lit(False).alias("is_directory"),
    )


def poll_tree(spark, root: str, state_dir: str, *, root_name: str | None = None, by: str = "stat", hide: Sequence[str] = ()) -> int:
    """List a tree, compare it with the listing before, and append the differences to the
    change feed ``<state_dir>/events`` (a folder that a stream reads). Returns the number of
    changes; the first listing only sets the mark. Listings are kept by number, the latest
    complete one counts. A poll that was cut short goes on with the listing it made, and leaves out the
    events it had appended, so each change is told once.
    """
    import os

    from corpuspack.session import materialize

    base = f"{state_dir.rstrip('/')}/listing"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(s.getPath().getName()) for s in (fs.listStatus(folder) if fs.exists(folder) else [])
                  if fs.exists(jvm.Path(s.getPath(), "_SUCCESS")))
    number = done[-1] + 1 if done else 0
    name = root_name or os.path.basename(os.path.normpath(root))
    listed = tree_snapshot(spark, root, by, hide).withColumn("path", F.concat(F.lit(name + "/"), "path"))
    now = f"{base}/{number:012d}"
    if done:
        schema = "path string, content_hash string"
        fresh, feed = f"{state_dir.rstrip('/')}/seen/{number:012d}", f"{state_dir.rstrip('/')}/events"
        again = fs.exists(jvm.Path(fresh, "_SUCCESS"))  # a poll that was cut short after its listing
        if not again:
            listed.write.mode("overwrite").parquet(fresh)  # listed once: what is compared is what is kept
        after = spark.read.schema(schema).parquet(fresh)
        changes = snapshot_changes(spark.read.schema(schema).parquet(f"{base}/{done[-1]:012d}"), after, name)
        changes = materialize(changes.withColumn("event_id", F.xxhash64("path", "kind", F.lit(number))), "poll-changes")
        told = changes
        if again and fs.exists(jvm.Path(feed)):  # it may have told of them already
            told = changes.join(spark.read.schema(changes.schema).parquet(feed).select("event_id"), "event_id", "left_anti").select(*changes.columns)
        told.write.mode("append").parquet(feed)
        after.write.mode("overwrite").parquet(now)
        return changes.count()
    listed.write.mode("overwrite").parquet(now)
    return 0
