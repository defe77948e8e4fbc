"""Directory-tree source: list (and optionally read) every file and directory under a root.

Spark's file listing skips names starting with ``_`` or ``.`` (``__init__.py`` would vanish),
so trees are listed by a Python data source. The driver expands the top of the tree breadth
first, for a bounded number of entries, so that the work splits even when one folder holds
most of the tree; executors then walk the remaining subtrees, and the files the driver saw
are read by executors in chunks. Unreadable directories are skipped, as the original tool
does.
"""

from __future__ import annotations

import datetime
import fnmatch
import itertools
import json
import os
import re

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuspack.schema import TREE_SCHEMA
from corpuspack.session import posix_path


class _Part(InputPartition):
    def __init__(self, walks, entries):
        self.walks = walks  # relative dirs whose subtrees this task lists
        self.entries = entries  # (relative path, is_dir) listed by the driver


def _scandir(full: str):
    """``(name, is_dir, linked)`` of a folder's entries, one by one as the system gives them: who stops
    early holds no more. A link to a folder is a directory that is not entered (so links can't form a
    loop); any other link is the file it leads to."""
    try:
        with os.scandir(full) as it:
            for e in it:
                yield e.name, e.is_dir(), e.is_dir() and e.is_symlink()
    except OSError:
        return


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, read_content: bool, target: int, driver_limit: int, chunk: int,
                 hide: list[str], prune: bool, exclude: list[str]):
        self.hide = [re.compile(fnmatch.translate(h)) for h in hide]
        self.prune = prune
        self.exclude = exclude
        self.root = root
        self.read_content = read_content
        self.target = target
        self.driver_limit = driver_limit
        self.chunk = chunk

    def _listed(self, d: str):
        """Entries of a folder that are shown: ``(relative path, is_dir, whether to enter it)``."""
        for name, is_dir, linked in _scandir(os.path.join(self.root, d)):
            rel = f"{d}/{name}" if d else name
            if self.prune and (name.startswith(".") or any(h.match(name) or (is_dir and h.match(rel + "/")) for h in self.hide)):
                continue
            if any(rel == x or rel.startswith(x + "/") for x in self.exclude):
                continue
            yield rel, is_dir, is_dir and not linked

    def partitions(self):
        """Folders to walk. The driver lists folders until there are enough, or until it holds
        ``driver_limit`` entries: a folder that goes beyond is left to a task as a whole."""
        entries, frontier = [], [""]
        ready = []  # folders that tasks walk
        while frontier and len(frontier) + len(ready) < self.target:
            below = []
            for d in frontier:
                room = self.driver_limit - len(entries)
                found = list(itertools.islice(self._listed(d), room + 1))
                if len(found) > room:
                    ready.append(d)
                    continue
                entries += [(rel, is_dir) for rel, is_dir, _ in found]
                below += [rel for rel, _, enter in found if enter]
            frontier = below
        ready += frontier
        parts = [_Part(ready[i::self.target], []) for i in range(min(self.target, len(ready)))]
        parts += [_Part([], entries[i:i + self.chunk]) for i in range(0, len(entries), self.chunk)]
        return parts or [_Part([], [])]

    def _row(self, rel: str, is_dir: bool):
        full = os.path.join(self.root, rel)
        try:
            st = os.stat(full)
            size, mtime = st.st_size, datetime.datetime.fromtimestamp(st.st_mtime, datetime.timezone.utc)
        except OSError:
            size, mtime = None, None
        if is_dir:
            return (rel, True, None, mtime, None)
        data = None
        if self.read_content:
            try:
                with open(full, "rb") as fh:
                    data = fh.read()
            except OSError:
                data = None
        return (rel, False, size, mtime, data)

    def read(self, partition):
        for rel, is_dir in partition.entries:
            yield self._row(rel, is_dir)
        for top in partition.walks:
            stack = [top]
            while stack:
                for rel, is_dir, enter in self._listed(stack.pop()):
                    yield self._row(rel, is_dir)
                    if enter:
                        stack.append(rel)


class TreeDataSource(DataSource):
    """``spark.read.format("filetree").option("path", root).load()``

    Options: ``readContent`` (default true), ``partitions`` (subtree tasks, default 64),
    ``driverEntries`` (entries the driver holds at most, default 100000), ``chunk`` (driver-listed
    entries per task, default 2000), ``hide`` and ``exclude`` (JSON lists, see :func:`list_tree`). Output: ``path`` relative to the root with '/'
    separators, ``is_dir``, ``length``, ``mtime``, ``content`` (raw bytes, NULL for
    directories).
    """

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return TREE_SCHEMA

    def reader(self, schema):
        o = self.options
        return _TreeReader(
            posix_path(o.get("path")),
            str(o.get("readContent", "true")).lower() == "true",
            int(o.get("partitions", "64")),
            int(o.get("driverEntries", "100000")),
            int(o.get("chunk", "2000")),
            json.loads(o.get("hide", "[]")),
            "hide" in o,
            json.loads(o.get("exclude", "[]")),
        )


def register(spark) -> None:
    spark.dataSource.register(TreeDataSource)


def list_tree(spark, root: str, read_content: bool = True, hide=None, exclude=(), **options):
    """Entries under ``root`` (the root itself excluded).

    With ``hide`` (globs, possibly none) dot entries and what the globs hide are left out while
    walking, so hidden subtrees are neither entered nor read. ``exclude`` are paths relative to
    the root that are left out with all below them (e.g. an output folder inside the tree).
    """
    register(spark)
    reader = spark.read.format("filetree").option("path", root).option("readContent", str(read_content).lower())
    if hide is not None:
        reader = reader.option("hide", json.dumps(list(hide)))
    if exclude:
        reader = reader.option("exclude", json.dumps(list(exclude)))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def walk_tree(spark, root: str, hide=None, exclude=(), folder_entries: int = 20_000, tasks: int | None = None):
    """``(path, is_dir, length, mtime)`` of the entries under ``root``, walked by tasks alone.

    The folders still to be listed are a table. A task lists its folders and what lies below them until
    it has seen ``folder_entries`` entries, and hands back the folders that are left; these are dealt
    out again. So a deep chain is followed in one task, a wide tree spreads with each round, and no more
    than a number of folders is held by the driver. One folder is read by one task, entry by entry; sizes
    and times are asked for afterwards, by all tasks alike. ``hide`` and ``exclude`` as in :func:`list_tree`.
    """
    from pyspark.sql import functions as F

    from corpuspack.session import write_table

    reader = _TreeReader(posix_path(root), False, 0, 0, 0, list(hide or []), hide is not None, list(exclude))
    n = tasks or max(2, spark.sparkContext.defaultParallelism)

    def walk(batches):
        stack = [p for b in batches for p in b.column(0).to_pylist()]
        seen, rows, asked = 0, [], 0

        def packed():
            out = pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "is_dir": [r[1] for r in rows], "left": [r[2] for r in rows]})
            rows.clear()
            return out

        while stack and (seen < folder_entries or not asked):
            asked += 1
            for rel, is_dir, enter in reader._listed(stack.pop()):
                seen += 1
                rows.append((rel, is_dir, False))
                if enter:
                    stack.append(rel)
                if len(rows) >= 1000:
                    yield packed()
        rows += [(p, True, True) for p in stack]
        if rows:
            yield packed()

    def measured(batches):
        for b in batches:
            found = [reader._row(p, d) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[2] for r in found], pa.int64()),
                                              pa.array([r[3] for r in found], pa.timestamp("us", "UTC"))], names=["path", "is_dir", "length", "mtime"])

    schema = "path string, is_dir boolean, left boolean"
    frontier, written = spark.createDataFrame([("",)], "path string"), []
    while not written or not frontier.isEmpty():
        written.append(write_table(frontier.repartition(n).mapInArrow(walk, schema), "walk"))
        frontier = spark.read.schema(schema).parquet(written[-1]).where("left").select("path")
    listed = spark.read.schema(schema).parquet(*written).where(~F.col("left")).select("path", "is_dir")
    return listed.repartition(n).mapInArrow(measured, "path string, is_dir boolean, length long, mtime timestamp")


def read_listed(listed, root: str):
    """``content`` (raw bytes, NULL if unreadable) for listed files ``(path, ...)``, read by the
    executors: list with ``read_content=False``, select, and read only what was selected."""
    root = posix_path(root)

    def run(batches):
        for batch in batches:
            for i, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as fh:
                        data = fh.read()
                except OSError:
                    data = None
                yield batch.slice(i, 1).append_column("content", pa.array([data], pa.binary()))

    rows = listed.drop("content")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))


def write_tree(files, root: str, text_col: str = "content") -> None:
    """Write a file table out as a directory tree under ``root`` (one file per row, UTF-8),
    from the executors; ``root`` must be a folder every executor sees."""
    root = posix_path(root)

    def write_part(rows):
        for r in rows:
            full = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as fh:
                fh.write(r[text_col].encode("utf-8"))

    os.makedirs(root, exist_ok=True)
    files.select("path", text_col).foreachPartition(write_part)


def write_folders(nodes, root: str) -> None:
    """Make the folders ``(path)`` under ``root``, from the executors."""
    root = posix_path(root)

    def make(rows):
        for r in rows:
            os.makedirs(os.path.join(root, r["path"]), exist_ok=True)

    nodes.select("path").foreachPartition(make)
