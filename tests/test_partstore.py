"""Bundles in parts: the index, the manifest, and changes that rewrite only their parts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuspack.operators import bundle as B
from corpuspack.operators.deltalog import DeltaLog
from corpuspack.operators.partstore import PartStore

SCHEMA = "bundle string, path string, content string"


def frame(spark, state):
    return spark.createDataFrame([(p.split("/")[0], p, c) for p, c in sorted(state.items())], SCHEMA)


def texts(store):
    """Each bundle's text, its parts' files in the order of their names."""
    out = {}
    live = {(r.bundle, r.part) for r in store.parts().collect()}
    for f in sorted(glob.glob(f"{store.folder}/data/area=text/bundle=*/part=*/part-*")):
        bundle, part = f.split("/bundle=")[1].split("/")[0], f.split("/part=")[1].split("/")[0]
        assert (bundle, part) in live, f
        out[bundle] = out.get(bundle, "") + open(f, encoding="utf-8", newline="").read()
    return out


def packed(files):
    rows = B.pack(files, remove_comments=True).orderBy("bundle", "okey").collect()
    out = {}
    for r in rows:
        out[r.bundle] = out.get(r.bundle, "") + r.block
    return out


def made(spark, tmp_dir, state, size=10):
    store = PartStore(spark, os.path.join(tmp_dir, "store"), files_per_part=size, remove_comments=True)
    store.build(frame(spark, state))
    return store


STATE = {f"{'big' if i % 4 else 'small'}/d{i % 7}/f{i:04d}.py": f"# c\nx = {i} é\n" * (i % 5) for i in range(300)}


def test_build_index_and_manifest(spark, tmp_dir):
    store = made(spark, tmp_dir, STATE)
    files = frame(spark, STATE)
    assert texts(store) == packed(files)
    want = {tuple(r) for r in B.pack_stats(files, remove_comments=True).select("bundle", "n_files", "n_lines", "n_chars", "kb").collect()}
    assert {tuple(r) for r in store.stats().select("bundle", "n_files", "n_lines", "n_chars", "kb").collect()} == want
    assert store.parts().where("bundle = 'big'").count() > 10
    whole = {b: t.encode() for b, t in texts(store).items()}
    entries = store.index().collect()
    assert len(entries) == 302
    blocks = {(r.bundle, r.path): r.block.encode() for r in B.pack(files, remove_comments=True).collect()}
    for e in entries:
        assert whole[e.bundle][e["at"]:e["at"] + e.bytes] == blocks[e.bundle, e.path]


def test_one_file_is_read_from_its_part(spark, tmp_dir):
    store = made(spark, tmp_dir, STATE)
    blocks = {(r.bundle, r.path): r.block for r in B.file_blocks(frame(spark, STATE), remove_comments=True).collect()}
    path = "big/d5/f0033.py"
    assert store.read_block("big", path) == blocks["big", path]
    with pytest.raises(KeyError):
        store.read_block("big", "big/none.py")
    wanted = spark.createDataFrame([k for k in blocks if k[1].endswith("3.py")], "bundle string, path string")
    assert {(r.bundle, r.path): r.block for r in store.read_blocks(wanted).collect()} == {k: v for k, v in blocks.items() if k[1].endswith("3.py")}
    part = store.index().where(F.col("path") == path).first().part
    damaged = glob.glob(f"{store.folder}/data/area=text/bundle=big/part={part}/part-*")[0]
    data = open(damaged, "rb").read()
    os.remove(damaged.replace("part-0", ".part-0") + ".crc")
    open(damaged, "wb").write(data.replace(b"x = 33", b"x = 34"))
    with pytest.raises(ValueError, match="damaged"):
        store.read_block("big", path)


def test_a_change_in_ten_thousand_files_rewrites_one_part(spark, tmp_dir):
    state = {f"b/d{i % 97}/f{i:05d}.txt": f"{i}\n" for i in range(10_000)}
    store = made(spark, tmp_dir, state, size=500)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.folder}/data/area=*/*/*/part-*")}
    state["b/d5/f00005.txt"] = "other\n"
    changed = spark.createDataFrame([("b", "b/d5/f00005.txt")], "bundle string, path string")
    assert store.update(frame(spark, state), changed, 0) == 1
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.folder}/data/area=*/*/*/part-*")}
    assert len(before) == len(after) and len(set(after.items()) - set(before.items())) == 2  # its text and its index
    assert texts(store) == packed(frame(spark, state))
    assert spark.read.parquet(f"{store.folder}/manifest/delta/*").count() == 1  # the state grew by the change


def test_tasks_do_not_grow_with_the_parts(spark, tmp_dir):
    """Each task's result goes to the driver: parts and the folders they lie in have no task of their own."""
    state = {f"b/d{i % 7}/f{i:05d}.txt": f"{i}\n" for i in range(1200)}
    paths = [(p.split("/")[0], p) for p in state]
    sc = spark.sparkContext
    sc.setJobGroup(tmp_dir, "parts")
    store = made(spark, tmp_dir, state)
    blocks = store.read_blocks(spark.createDataFrame(paths, "bundle string, path string")).count()
    state.update(dict.fromkeys(state, "other\n"))
    written = store.update(frame(spark, state), spark.createDataFrame(paths, "bundle string, path string"), 0)
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(tmp_dir) for s in sc.statusTracker().getJobInfo(j).stageIds}
    infos = [sc.statusTracker().getStageInfo(s) for s in stages]
    assert blocks == 1200 and written == store.parts().count() > 90
    assert max(i.numTasks for i in infos if i) <= 32
    assert texts(store) == packed(frame(spark, state))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_random_changes_equal_a_build(spark, tmp_dir):
    rng = random.Random(8)
    state = dict(list(STATE.items())[:80])
    store = made(spark, tmp_dir, state, size=6)
    store.manifest.keep = 3  # compacted on the way
    for version in range(6):
        gone = rng.sample(sorted(state), 8) if version != 3 else [p for p in state if p.startswith("small/")]
        new = [f"{rng.choice(['big', 'small', 'new'])}/d{rng.randrange(9)}/g{rng.randrange(1000)}.py" for _ in range(25)] if version != 3 else []
        other = rng.sample(sorted(set(state) - set(gone)), 4)
        for p in gone:
            del state[p]
        state.update({p: f"# c\nnew {version}\n" for p in new + other})
        changed = spark.createDataFrame([(p.split("/")[0], p) for p in {*gone, *new, *other}], "bundle string, path string")
        files = frame(spark, state)
        store.update(files, changed, version)
        if version == 2:  # the same step again, as after a crash
            store.update(files, changed, version)
        assert texts(store) == packed(files), version
        want = {tuple(r) for r in B.pack_stats(files, remove_comments=True).select("bundle", "n_files", "n_lines", "n_chars").collect()}
        assert {tuple(r) for r in store.stats().select("bundle", "n_files", "n_lines", "n_chars").collect()} == want
    sizes = [r.files for r in store.parts().collect()]
    assert max(sizes) <= 12 and len(sizes) > 10


def test_empty_and_null_bundles(spark, tmp_dir):
    store = PartStore(spark, os.path.join(tmp_dir, "none"))
    nothing = spark.createDataFrame([], SCHEMA)
    store.build(nothing)
    assert store.parts().count() == 0 and store.stats().count() == 0
    odd = spark.createDataFrame([(None, "x/a.py", "1\n"), ("007", "007/a.py", "2\n"), ("a b%/=c", "a b%/=c/é.py", "3\n"), ("7", "7/bad.py", None)], SCHEMA)
    store = PartStore(spark, os.path.join(tmp_dir, "odd"))
    store.build(odd)
    got = {(r.bundle, r.path): r.block for r in store.read_blocks(odd.select("bundle", "path")).collect()}
    assert got == {(r.bundle, r.path): r.block for r in B.file_blocks(odd).collect()}
    assert store.read_block("a b%/=c", "a b%/=c/é.py") == got["a b%/=c", "a b%/=c/é.py"]
    changed = spark.createDataFrame([("007", "007/a.py"), (None, "x/a.py")], "bundle string, path string")
    store.update(odd.where("path <> '007/a.py'"), changed, 0)
    assert {r.bundle for r in store.parts().collect()} == {None, "7", "a b%/=c"}


def test_delta_log(spark, tmp_dir):
    log = DeltaLog(spark, os.path.join(tmp_dir, "log"), ["k"], "k string, x long", keep=3)
    assert log.last() is None and log.current().count() == 0
    log.start(spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x long"))
    model = {"a": 1, None: 2, "c": 3}
    rng = random.Random(2)
    for v in range(9):
        before = dict(model)
        rows = []
        for k in rng.sample(["a", "b", None, "c", "d"], 3):
            gone = rng.random() < 0.4
            rows.append((k, None if gone else v, gone))
            model.pop(k, None) if gone else model.__setitem__(k, v)
        delta = spark.createDataFrame(rows, "k string, x long, gone boolean")
        log.append(v, delta)
        assert {r.k: r.x for r in log.current(before=v).collect()} == before
        log.append(v, delta)  # again
        assert {r.k: r.x for r in log.current().collect()} == model and log.last() == v
    assert len(glob.glob(os.path.join(tmp_dir, "log", "base", "v*"))) > 1
