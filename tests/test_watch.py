"""Change feed: filter, throttle (batch, stream), snapshot diff, callbacks, rebuilds."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from corpuspack.operators import bundle as B
from corpuspack.streaming import watch as W
from models import model_throttle

EPOCH = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    data = [(i, EPOCH + dt.timedelta(seconds=t), root, path, "modified", isdir)
            for i, (t, root, path, isdir) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, root string, path string, kind string, "
                                       "is_directory boolean")


def test_golden_throttle(spark):
    times = [0.0, 0.3, 0.5, 0.9, 1.0, 1.6]
    ev = _events(spark, [(t, "r", f"f{i}.py", False) for i, t in enumerate(times)])
    kept = sorted(r.event_id for r in W.throttle(ev, 0.5).collect())
    assert kept == [0, 2, 4, 5] == model_throttle(times, 0.5)


def test_filter_runs_before_throttle(spark):
    rows = [(0.0, "r", "a/dir", True), (0.1, "r", "x.md", False), (0.2, "r", "tests/x.py", False),
            (0.6, "r", "y.py", False), (0.8, "r", "z.py", False)]
    ev = W.watch_filter(_events(spark, rows), ".py", ignore_paths=["tests/"])
    assert sorted(r.path for r in W.throttle(ev, 0.5).collect()) == ["y.py"]


def test_backslash_paths_normalised(spark):
    ev = W.watch_filter(_events(spark, [(0.0, "r", "a\\b\\c.py", False)]))
    assert ev.first().path == "a/b/c.py"


def test_throttle_random_equal_model(spark):
    rng = random.Random(4)
    rows = []
    for root in ["r1", "r2", "r3"]:
        t = 0.0
        for _ in range(rng.randint(50, 400)):
            t += rng.choice([10, 200, 490, 500, 510, 1300]) / 1000  # whole milliseconds: exact in both
            rows.append((round(t, 3), root, f"p{len(rows)}.py", False))
    ev = _events(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # carry state across batches
    try:
        got = {r.event_id for r in W.throttle(ev, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expect = set()
    for root in ["r1", "r2", "r3"]:
        idx = [i for i, r in enumerate(rows) if r[1] == root]
        expect |= {idx[k] for k in model_throttle([round(rows[i][0] * 1000) for i in idx], 500)}
    assert got == expect
    last = {r.root: r.last_path for r in W.last_changed(W.throttle(ev, 0.5)).collect()}
    for root in ["r1", "r2", "r3"]:
        assert last[root] == rows[max(i for i in expect if rows[i][1] == root)][2]


ONCE = {"availableNow": True}


def _write_stream_input(spark, ev, d, n_files=4):
    pdf = ev.toPandas().sort_values("ts")
    for k, chunk in enumerate(range(0, len(pdf), max(1, len(pdf) // n_files + 1))):
        part = pdf.iloc[chunk: chunk + len(pdf) // n_files + 1]
        spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(os.path.join(d, f"batch={k:03d}"))


def test_stream_throttle_equals_batch(spark, tmp_dir):
    rng = random.Random(9)
    rows = []
    t = 0.0
    for i in range(300):
        t += rng.choice([0.1, 0.3, 0.6])
        rows.append((t, rng.choice(["a", "b"]), f"f{i}.py", rng.random() < 0.05))
    ev = _events(spark, rows)
    src = os.path.join(tmp_dir, "events")
    _write_stream_input(spark, ev, src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    seen = []

    def cb(df, batch_id):
        seen.extend(r.event_id for r in df.collect())

    q = W.watch(stream, cb, gap_seconds=0.5, checkpoint=os.path.join(tmp_dir, "ck"), trigger=ONCE)
    q.awaitTermination(120)
    batch = {r.event_id for r in W.throttle(W.watch_filter(ev), 0.5).collect()}
    assert sorted(seen) == sorted(batch) and len(seen) == len(set(seen))


def test_snapshot_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, content_hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "9"), ("w", "4")], "path string, content_hash string")
    got = sorted((r.path, r.kind) for r in W.snapshot_diff(a, b).collect())
    assert got == [("w", "created"), ("x", "deleted"), ("z", "modified")]


def _bundle_text(out, b):
    d = os.path.join(out, f"bundle={b}")
    return "".join(open(os.path.join(d, f)).read() for f in sorted(os.listdir(d)) if f.startswith("part"))


def test_rebuild_only_hit_bundles(spark, tmp_dir):
    files = spark.createDataFrame(
        [("p", "p/a.py", "# c\nx\n"), ("p", "p/b.py", "y\n"), ("q", "q/c.py", "z\n"), ("r", "r/d.py", "w\n")],
        "bundle string, path string, content string")
    sel = spark.createDataFrame([("p/a.py",), ("q/c.py",), ("r/d.py",)], "path string")
    out = os.path.join(tmp_dir, "bundles")
    B.write_bundles(B.pack(files.join(sel, "path", "left_semi"), remove_comments=True), out)
    before = {b: _bundle_text(out, b) for b in "pqr"}
    rb = W.BundleRebuilder(lambda: files, sel, out, os.path.join(tmp_dir, "state"), remove_comments=True)
    src = os.path.join(tmp_dir, "ev")
    ev = _events(spark, [(0.0, "p", "p/a.py", False), (5.0, "p", "p/b.py", False), (9.0, "q", "q/zz.py", False)])
    _write_stream_input(spark, ev, src, n_files=1)
    stream = spark.readStream.schema(ev.schema).parquet(src + "/*")
    q = W.watch(stream, rb, gap_seconds=0.5, checkpoint=os.path.join(tmp_dir, "ck"), trigger=ONCE)
    q.awaitTermination(120)
    assert [r.bundle for r in rb.rebuilt_bundles(spark).collect()] == ["p"]  # p/b.py and q/zz.py were not selected
    for b in "qr":
        assert os.path.isdir(os.path.join(out, f"bundle={b}"))
    got = _bundle_text(out, "p")
    assert got == before["p"] == "# Files combined from: p\n\n# ==== BEGIN FILE: a.py ====\nx\n\n# ==== END FILE: a.py ====\n\n"
    # a full build at start (no confirmation) rewrites every selected bundle the same way
    rb.build_all(spark)
    assert {b: _bundle_text(out, b) for b in "pqr"} == before


def test_throttle_jump_equals_scan_and_model(spark):
    rng = random.Random(21)
    rows = []
    for root, n, steps in [("hot", 1500, [1, 5, 100, 250, 499, 500, 501]), ("r2", 120, [300, 700, 1600]),
                           ("r3", 3, [2000])]:
        t = 0
        for _ in range(n):
            t += rng.choice(steps + [0])  # 0: equal times (tie broken by event id)
            rows.append((t / 1000, root, f"p{len(rows)}.py", False))
    ev = _events(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")  # carries across batches
    try:
        jump = {r.event_id for r in W.throttle(ev, 0.5, method="jump").collect()}
        auto = {r.event_id for r in W.throttle(ev, 0.5, method="auto", hot_rows=1000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expect = set()
    for root in ["hot", "r2", "r3"]:
        idx = [i for i, r in enumerate(rows) if r[1] == root]
        expect |= {idx[k] for k in model_throttle([round(rows[i][0] * 1000) for i in idx], 500)}
    assert jump == expect and auto == expect


def test_epoch_micros_ignores_session_zone(spark):
    from corpuspack.functions.times import epoch_micros

    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:07.179575' AS a, TIMESTAMP'2024-01-01 00:00:07Z' AS b")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ["UTC", "America/Los_Angeles", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(tuple(df.select(epoch_micros(df, "a"), epoch_micros(df, "b")).first()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert set(got) == {(1704067207179575, 1704067207000000)}


def test_polled_tree_changes(spark, tmp_dir):
    root = os.path.join(tmp_dir, "proj")
    os.makedirs(os.path.join(root, "pkg"))
    for name, text in [("pkg/__init__.py", "a"), ("pkg/m.py", "b"), ("gone.py", "c")]:
        open(os.path.join(root, name), "w").write(text)
    listing = W.tree_snapshot(spark, root)
    before = spark.createDataFrame(listing.collect(), listing.schema)  # freeze the small test listing
    open(os.path.join(root, "pkg/m.py"), "w").write("changed")
    os.remove(os.path.join(root, "gone.py"))
    open(os.path.join(root, "new.py"), "w").write("n")
    after = W.tree_snapshot(spark, root)
    ev = W.snapshot_changes(before, after, "proj", at=dt.datetime(2024, 1, 1))
    got = sorted((r.path, r.kind, r.root, r.is_directory) for r in ev.collect())
    assert got == [("gone.py", "deleted", "proj", False), ("new.py", "created", "proj", False),
                   ("pkg/m.py", "modified", "proj", False)]
    kept = W.throttle(W.watch_filter(ev), 0.5)
    assert kept.count() == 1  # all three at one instant: the throttle keeps the first
    # the stat-based snapshot sees the same changes without reading contents
    os.utime(os.path.join(root, "pkg/m.py"), (1, 1))
    stat_after = W.tree_snapshot(spark, root, by="stat")
    frozen = spark.createDataFrame(stat_after.collect(), stat_after.schema)
    os.utime(os.path.join(root, "pkg/m.py"), (2, 2))
    stat_later = W.tree_snapshot(spark, root, by="stat")
    assert [(r.path, r.kind) for r in W.snapshot_diff(frozen, stat_later).collect()] == [("pkg/m.py", "modified")]


def test_deleted_selected_file_rebuilds_its_bundle(spark, tmp_dir):
    before_files = spark.createDataFrame([("p", "p/a.py", "x\n"), ("p", "p/b.py", "y\n"), ("q", "q/c.py", "z\n")],
                                         "bundle string, path string, content string")
    after_files = before_files.where("path <> 'p/b.py'")  # b.py was deleted
    sel = spark.createDataFrame([("p/a.py",), ("p/b.py",), ("q/c.py",)], "path string")
    out = os.path.join(tmp_dir, "bundles")
    B.write_bundles(B.pack(before_files.join(sel, "path", "left_semi")), out)
    rb = W.BundleRebuilder(lambda: after_files, sel, out, os.path.join(tmp_dir, "state"))
    src = os.path.join(tmp_dir, "ev")
    ev = _events(spark, [(0.0, "p", "p/b.py", False)])
    _write_stream_input(spark, ev, src, n_files=1)
    stream = spark.readStream.schema(ev.schema).parquet(src + "/*")
    W.watch(stream, rb, checkpoint=os.path.join(tmp_dir, "ck"), trigger=ONCE).awaitTermination(120)
    assert [r.bundle for r in rb.rebuilt_bundles(spark).collect()] == ["p"]
    assert "b.py" not in _bundle_text(out, "p") and "a.py" in _bundle_text(out, "p")
    assert "c.py" in _bundle_text(out, "q")


def test_a_null_root_is_a_root(spark):
    rows = [(0.0, None, "a", False), (0.2, None, "b", False), (0.7, None, "c", False), (0.8, None, "d", False),
            (1.4, None, "e", False), (0.1, "r", "f", False)]
    ev = _events(spark, rows)
    want = {0, 2, 4, 5}
    for method, hot in (("scan", 10), ("jump", 10), ("auto", 2)):
        assert {r.event_id for r in W.throttle(ev, 0.5, method=method, hot_rows=hot).collect()} == want, method


def test_a_watch_resumes_with_its_state(spark, tmp_dir):
    files = spark.createDataFrame([(b, f"{b}/f.py", f"{b}\n") for b in "abcd"], "bundle string, path string, content string")
    out, state, src = (os.path.join(tmp_dir, n) for n in ("out", "state", "ev"))
    every = files.select("path")

    def run(file_table, selection):
        rb = W.BundleRebuilder(lambda: file_table, selection, out, state)
        stream = spark.readStream.schema(_events(spark, []).schema).parquet(src + "/*")
        W.watch(stream, rb, checkpoint=os.path.join(state, "checkpoint"), trigger=ONCE).awaitTermination(120)
        return rb

    _write_stream_input(spark, _events(spark, [(0.0, "a", "a/f.py", False), (0.1, "b", "b/f.py", False)]), src, n_files=1)
    first = run(files.where("bundle <> 'c'"), every)  # c/f.py is gone, so it leaves the selection
    assert first.rebuilt and sorted(r.path for r in first.current_selection(spark).collect()) == ["a/f.py", "b/f.py", "d/f.py"]
    late = _events(spark, [(0.2, "a", "a/f.py", False), (3.0, "c", "c/f.py", False), (4.0, "d", "d/f.py", False)])
    late.write.parquet(os.path.join(src, "batch=later"))
    again = run(files, every)  # the state's selection counts, not the one given
    assert sorted(r.path for r in again.current_selection(spark).collect()) == ["a/f.py", "b/f.py", "d/f.py"]
    assert sorted(r.bundle for r in again.rebuilt_bundles(spark).collect()) == ["a", "b", "d"]  # a's second change came too soon


def test_more_bundles_than_a_report_holds(spark, tmp_dir):
    n = 130
    files = spark.createDataFrame([(f"b{i}", f"b{i}/f.py", "x\n") for i in range(n)], "bundle string, path string, content string")
    rb = W.BundleRebuilder(lambda: files, files.select("path"), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state"))
    rb(_events(spark, [(0.0, f"b{i}", f"b{i}/f.py", False) for i in range(n)]), 0)
    assert rb.rebuilt_bundles(spark).count() == n


def test_polling_appends_changes(spark, tmp_dir):
    root, state = os.path.join(tmp_dir, "proj"), os.path.join(tmp_dir, "state")
    os.makedirs(os.path.join(root, ".git"))
    open(os.path.join(root, "a.py"), "w").write("a")
    open(os.path.join(root, ".git", "x"), "w").write("a")
    assert W.poll_tree(spark, root, state) == 0
    assert W.poll_tree(spark, root, state) == 0
    open(os.path.join(root, "b.py"), "w").write("b")
    open(os.path.join(root, ".git", "x"), "w").write("longer")
    assert W.poll_tree(spark, root, state) == 1 and W.poll_tree(spark, root, state) == 0
    os.remove(os.path.join(root, "a.py"))
    assert W.poll_tree(spark, root, state) == 1
    ev = spark.read.parquet(os.path.join(state, "events")).orderBy("ts").collect()
    assert [(r.path, r.kind, r.root) for r in ev] == [("proj/b.py", "created", "proj"), ("proj/a.py", "deleted", "proj")]


def test_null_hashes_are_compared(spark):
    before = spark.createDataFrame([("both", None), ("gone", None), ("got", None), ("lost", "x"), ("same", "s")], "path string, content_hash string")
    after = spark.createDataFrame([("both", None), ("new", None), ("got", "x"), ("lost", None), ("same", "s")], "path string, content_hash string")
    got = {(r.path, r.kind) for r in W.snapshot_diff(before, after).collect()}
    assert got == {("gone", "deleted"), ("new", "created"), ("got", "modified"), ("lost", "modified")}


def test_stream_throttle_of_any_cut_equals_the_batch(spark, tmp_dir):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 100, 250, 499, 500, 700])
        rows.append((t / 1000, rng.choice(["hot", "hot", "hot", "r", None]), f"p{i}.py", False))
    ev = _events(spark, rows)
    want = sorted(r.event_id for r in W.throttle(ev, 0.5).collect())
    for n, hot_rows in ((1, 50), (6, 2_000_000)):
        keep = W.BatchThrottle(os.path.join(tmp_dir, f"state{n}"), 0.5, hot_rows=hot_rows)
        cuts = sorted({0, len(rows), *rng.sample(range(len(rows)), n - 1)})
        got = []
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            part = ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi))
            first = sorted(r.event_id for r in keep(part, k).collect())
            if k == 1:  # the micro-batch runs again
                assert sorted(r.event_id for r in keep(part, k).collect()) == first
            got += first
        assert sorted(got) == want


def test_every_change_of_a_poll_reaches_the_rebuild(spark, tmp_dir):
    files = {"p/a.py": "x\n", "p/b.py": "y\n", "q/c.py": "z\n"}

    def table():
        return spark.createDataFrame([(p[0], p, c) for p, c in sorted(files.items())], "bundle string, path string, content string")

    sel = spark.createDataFrame([("p/b.py",), ("q/c.py",)], "path string")
    out, src = os.path.join(tmp_dir, "parts"), os.path.join(tmp_dir, "ev")
    rb = W.PartRebuilder(table, sel, out, os.path.join(tmp_dir, "state"), select=lambda f: f.where(F.col("path").endswith(".md")))
    rb.build_all(spark)
    files["p/b.py"] = "changed\n"
    files["p/n.md"] = "new\n"
    del files["q/c.py"]
    # one time for all, and the first isn't selected: a throttle would keep that one only
    ev = _events(spark, [(0.0, "p", "p/a.py", False), (0.0, "p", "p/b.py", False), (0.0, "p", "p/n.md", False), (0.0, "q", "q/c.py", False)])
    _write_stream_input(spark, ev, src, n_files=1)
    stream = spark.readStream.schema(ev.schema).parquet(src + "/*")
    W.watch(stream, rb, checkpoint=os.path.join(tmp_dir, "ck"), trigger=ONCE, coalesce=True).awaitTermination(120)
    assert rb.rebuilt and sorted(r.path for r in rb.current_selection(spark).collect()) == ["p/b.py", "p/n.md"]
    chosen = table().where("path in ('p/b.py', 'p/n.md')")
    want = {tuple(r) for r in B.pack_stats(chosen).select("bundle", "n_files", "n_lines", "n_chars").collect()}
    assert {tuple(r) for r in rb.store(spark).stats().select("bundle", "n_files", "n_lines", "n_chars").collect()} == want
    assert "changed" in rb.store(spark).read_block("p", "p/b.py")


def test_a_poll_cut_short_tells_each_change_once(spark, tmp_dir):
    import shutil

    root, state = os.path.join(tmp_dir, "proj"), os.path.join(tmp_dir, "state")
    os.makedirs(root)
    open(os.path.join(root, "a.py"), "w").write("a")
    W.poll_tree(spark, root, state)
    open(os.path.join(root, "b.py"), "w").write("b")
    assert W.poll_tree(spark, root, state) == 1
    shutil.rmtree(os.path.join(state, "listing", "000000000001"))  # as if it ended before its listing was there
    open(os.path.join(root, "c.py"), "w").write("c")
    W.poll_tree(spark, root, state)
    W.poll_tree(spark, root, state)
    ev = spark.read.parquet(os.path.join(state, "events")).collect()
    assert sorted((r.path, r.kind) for r in ev) == [("proj/b.py", "created"), ("proj/c.py", "created")]


def test_the_selection_log_holds_changes_only(spark, tmp_dir):
    import glob as g

    files = spark.createDataFrame([("a", f"a/f{i}.py", "x\n") for i in range(50)], "bundle string, path string, content string")
    every = files.select("path").unionByName(spark.createDataFrame([("a/gone.py",)], "path string"))
    rb = W.BundleRebuilder(lambda: files, every, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "state"))
    for batch in range(3):
        rb(_events(spark, [(0.0, "a", "a/f1.py", False)]), batch)
    assert rb.current_selection(spark).count() == 50
    assert spark.read.parquet(*g.glob(os.path.join(tmp_dir, "state/selection/delta/*"))).count() == 1
