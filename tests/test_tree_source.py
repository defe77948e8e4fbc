"""Directory-tree data source: names with '_' and '.' are listed (Spark's file listing drops them)."""

import os

from corpuspack.sources.tree import list_tree


def test_lists_underscore_and_dot_names(spark, tmp_dir):
    root = os.path.join(tmp_dir, "proj")
    for d in ["pkg/_priv", ".git", "empty", "a/b"]:
        os.makedirs(os.path.join(root, d))
    files = {"pkg/__init__.py": b"x = 1\n", "pkg/_priv/z.py": b"z\n", ".git/HEAD": b"ref\n",
             "a/b/c.txt": b"\xff\xfe", "top.md": b"# t\n"}
    for p, data in files.items():
        with open(os.path.join(root, p), "wb") as fh:
            fh.write(data)
    rows = {r.path: r for r in list_tree(spark, root).collect()}
    assert set(rows) == set(files) | {"pkg", "pkg/_priv", ".git", "empty", "a", "a/b"}
    assert rows["pkg/__init__.py"].content == b"x = 1\n" and rows["pkg/__init__.py"].length == 6
    assert rows["empty"].is_dir and rows["empty"].content is None


def test_listing_only(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "d"))
    open(os.path.join(tmp_dir, "d", "f.py"), "w").write("abc")
    rows = list_tree(spark, tmp_dir, read_content=False).collect()
    assert {(r.path, r.content) for r in rows} == {("d", None), ("d/f.py", None)}


def test_split_options_give_the_same_listing(spark, tmp_dir):
    root = os.path.join(tmp_dir, "t")
    for i in range(30):
        d = os.path.join(root, f"d{i % 3}", f"s{i % 5}")
        os.makedirs(d, exist_ok=True)
        open(os.path.join(d, f"f{i}.py"), "w").write("x" * i)
    os.makedirs(os.path.join(root, "flat"))
    for i in range(50):
        open(os.path.join(root, "flat", f"g{i}"), "w").write("y")
    base = sorted(tuple(r) for r in list_tree(spark, root).collect())
    for opts in [dict(partitions=1), dict(partitions=2, driverEntries=3, chunk=1), dict(partitions=100, chunk=7)]:
        got = list_tree(spark, root, **opts)
        assert sorted(tuple(r) for r in got.collect()) == base, opts
    assert len(base) == 30 + 50 + 1 + 3 + 3 * 5


def _make(root, files):
    for p, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        open(os.path.join(root, p), "w").write(text)


def test_hidden_parts_are_not_entered(spark, tmp_dir):
    root = os.path.join(tmp_dir, "h")
    _make(root, {"a/x.py": "1", ".git/y": "2", "a/.hid/z": "3", "skip/w": "4", "a/b.meta": "5", "out/old.txt": "6", "a/out/n": "7"})
    got = {r.path for r in list_tree(spark, root, hide=["skip/", "*.meta"], exclude=["out"]).collect()}
    assert got == {"a", "a/x.py", "a/out", "a/out/n"}
    assert {r.path for r in list_tree(spark, root, hide=[]).collect()} >= {"skip/w", "a/b.meta"}


def test_links_to_folders_are_listed_and_not_entered(spark, tmp_dir):
    root = os.path.join(tmp_dir, "l")
    _make(root, {"real/f.py": "abc"})
    os.symlink(os.path.join(root, "real"), os.path.join(root, "link"))
    os.symlink(root, os.path.join(root, "real", "up"))  # a loop
    os.symlink(os.path.join(root, "real", "f.py"), os.path.join(root, "file_link"))
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "broken"))
    got = {r.path: (r.is_dir, r.length) for r in list_tree(spark, root).collect()}
    assert got == {"real": (True, None), "real/f.py": (False, 3), "link": (True, None), "real/up": (True, None),
                   "file_link": (False, 3), "broken": (False, None)}


def test_the_driver_holds_no_more_entries_than_it_may(spark, tmp_dir):
    from corpuspack.sources.tree import TreeDataSource

    root = os.path.join(tmp_dir, "f")
    _make(root, {f"flat/g{i}": "" for i in range(300)} | {"d/e": "x"})
    parts = TreeDataSource({"path": root, "driverEntries": "10"}).reader(None).partitions()
    assert sum(len(p.entries) for p in parts) <= 10
    assert list_tree(spark, root, driverEntries=10).count() == 303


def test_selected_files_only_are_read(spark, tmp_dir):
    from corpuspack.sources.tree import read_listed

    root = os.path.join(tmp_dir, "r")
    _make(root, {"a.py": "A", "b.py": "B"})
    listed = list_tree(spark, root, read_content=False).where("path = 'a.py'")
    rows = read_listed(listed.select("path").unionByName(spark.createDataFrame([("gone",)], "path string")), root).collect()
    assert sorted((r.path, r.content and bytes(r.content)) for r in rows) == [("a.py", b"A"), ("gone", None)]


def test_a_store_is_listed_through_spark(spark, tmp_dir):
    from corpuspack.sources.files import list_store

    root = os.path.join(tmp_dir, "store")
    _make(root, {"a/x y.py": "1", "b/c/z.md": "22", "_hidden": "3"})
    rows = {r.path: (r.is_dir, r.length, bytes(r.content)) for r in list_store(spark, root).collect()}
    assert rows == {"a/x y.py": (False, 1, b"1"), "b/c/z.md": (False, 2, b"22")}
    listed = list_store(spark, "file://" + root, read_content=False)
    assert {(r.path, r.content) for r in listed.collect()} == {("a/x y.py", None), ("b/c/z.md", None)}


def test_the_driver_never_holds_a_flat_folder(spark, tmp_dir, monkeypatch):
    from corpuspack.sources import tree

    for i in range(3000):
        open(os.path.join(tmp_dir, f"f{i:04d}"), "w").close()
    taken, plain = [], tree._scandir

    def counted(full):
        for e in plain(full):
            taken.append(e)
            yield e

    monkeypatch.setattr(tree, "_scandir", counted)
    reader = tree._TreeReader(tmp_dir, False, 64, 10, 2000, [], False, [])
    parts = reader.partitions()
    assert len(taken) <= 11 and sum(len(p.entries) for p in parts) == 0
    assert sum(len(list(reader.read(p))) for p in parts) == 3000


def test_walk_of_deep_flat_and_hidden_folders(spark, tmp_dir):
    from corpuspack.sources.tree import list_tree, walk_tree

    deep = os.path.join(tmp_dir, *["d"] * 60)
    os.makedirs(deep)
    open(os.path.join(deep, "end.py"), "w").write("abc")
    for k in range(40):
        os.makedirs(os.path.join(tmp_dir, f"w{k}", "x", ".hid"))
        for i in range(10):
            open(os.path.join(tmp_dir, f"w{k}", "x", f"f{i}.py"), "w").write("x" * i)
    os.makedirs(os.path.join(tmp_dir, "flat"))
    for i in range(700):
        open(os.path.join(tmp_dir, "flat", f"{i}.md"), "w").close()
    os.symlink(tmp_dir, os.path.join(tmp_dir, "w0", "loop"))
    for hide, exclude in ((None, ()), (["w1*"], ("flat",))):
        want = {tuple(r) for r in list_tree(spark, tmp_dir, read_content=False, hide=hide, exclude=exclude).select("path", "is_dir", "length", "mtime").collect()}
        for entries in (1, 30, 100_000):
            got = walk_tree(spark, tmp_dir, hide=hide, exclude=exclude, folder_entries=entries, tasks=3).collect() if entries > 1 or hide else None
            if got is not None:
                assert len(got) == len(want) and {tuple(r) for r in got} == want
