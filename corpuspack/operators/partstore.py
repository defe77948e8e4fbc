"""Bundles stored in parts, with an index of their blocks and a manifest of the parts.

A part holds the blocks of one bundle whose order keys lie in one range, as one text file. The write
that makes it also writes its index: a line per block with its path, size, lines, characters and
checksum, in the order of the blocks, so the sizes before a block are its offset in the part. The
manifest has a row per part: where its range begins, first and last key, files, bytes, lines and
characters. Statistics come from the manifest and a file is read back by its offset; no bundle is read
to tell anything about it.

A change rewrites the parts whose ranges hold the changed keys and no others. Parts that grew beyond
twice their size are split; part names are numbers with gaps, so that names in between are free and the
order of names stays the order of keys. The manifest is a log of changes (:class:`DeltaLog`).

The starts of the parts of the bundles that change are held by the driver: some 200 bytes a part.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.operators import bundle as B
from corpuspack.operators.deltalog import DeltaLog

GAP = 1_000_000
#: Files that a writing task is meant to hold at least: small parts share a task, as each task's result
#: goes to the driver.
TASK_FILES = 10_000
_INDEX = "okey string, path string, is_file boolean, bytes long, lines long, chars long, md5 string"
_MANIFEST = ("bundle string, part string, start string, first_key string, last_key string, files long, "
             "bytes long, lines long, chars long")


def part_name(number: int) -> str:
    return f"{number:018d}"


def _order(bundle: str | None, okey: str) -> tuple:
    return (bundle is not None, (bundle or "").encode(), okey.encode())


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by as many tasks as the session shuffles with, not by a task each (up to 10,000),
    whose results would all go to the driver."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class PartStore:
    """Bundles under ``folder``. ``files_per_part`` is the size that parts are meant to have."""

    def __init__(self, spark: SparkSession, folder: str, *, files_per_part: int = 10_000,
                 remove_comments: bool = False, remove_docstrings: bool = False):
        self.spark, self.folder, self.files_per_part = spark, folder.rstrip("/"), files_per_part
        self.options = {"remove_comments": remove_comments, "remove_docstrings": remove_docstrings}
        self.manifest = DeltaLog(spark, f"{self.folder}/manifest", ["bundle", "part"], _MANIFEST)

    # ------------------------------------------------------------------ writing

    def _tasks(self, parts: int) -> int:
        """Tasks that write so many parts, each part by one of them."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(parts, max(least, -(-parts * self.files_per_part // TASK_FILES))))

    def _write(self, blocks: DataFrame, starts: list[Row], chosen: list[int] | None) -> None:
        """Write the blocks of all ranges of ``starts(bundle, okey, part)``, or of the chosen ones."""
        names = F.from_json(F.lit(json.dumps([s["part"] for s in starts])), "array<string>")
        rows = B.with_range(blocks, starts)
        if chosen is not None:
            rows = rows.where(F.col("_range").isin(chosen))
        sized = rows.select(
            "bundle", "okey", "_range", F.get(names, F.col("_range")).alias("part"), "block", F.to_json(F.struct(
                "okey", "path", "is_file", F.octet_length("block").alias("bytes"), T.newline_count("block").alias("lines"),
                T.char_count("block").alias("chars"), F.md5("block").alias("md5"))).alias("entry"))
        text = F.expr("substring(block, 1, length(block) - 1)")  # the sink adds the line's end
        both = F.array(F.struct(F.lit("index").alias("area"), F.col("entry").alias("value")),
                       F.struct(F.lit("text").alias("area"), text.alias("value")))
        rows = sized.select("bundle", "part", "okey", "_range", F.explode(both).alias("x")).select("x.*", "bundle", "part", "okey", "_range")
        if chosen is None:
            n = self._tasks(len(starts))
            dealt = rows.repartitionById(n, F.floor(F.col("_range") * F.lit(n).cast("long") / len(starts)).cast("int"))
        else:
            dealt = rows.repartition(self._tasks(len(chosen)), "_range")
        (dealt.sortWithinPartitions("area", "bundle", "part", "okey").select("area", "bundle", "part", "value")
            .write.mode("overwrite").option("partitionOverwriteMode", "static" if chosen is None else "dynamic")
            .partitionBy("area", "bundle", "part").text(f"{self.folder}/data"))

    def _load(self, area: str, kind: str, schema: str, **options: str) -> DataFrame:
        """The files of an area; those of other areas are not listed."""
        data = f"{self.folder}/data"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{data}/area={area}")
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)  # not without a block
        reader = self.spark.read.format(kind).schema(f"{schema}, area string, bundle string, part string").options(basePath=data, **options)
        with few_listing_tasks(self.spark):
            return reader.load(f"{data}/area={area}" if there else data).where(F.col("area") == area).drop("area")

    def _rows(self, area: str) -> DataFrame:
        return self._load(area, "text", "value string", lineSep="\n")

    def _entries(self) -> DataFrame:
        return self._rows("index").select("bundle", "part", F.from_json("value", _INDEX).alias("e")).select("bundle", "part", "e.*")

    def _summed(self, entries: DataFrame, starts: DataFrame) -> DataFrame:
        """Manifest rows of index entries."""
        parts = entries.groupBy("bundle", "part").agg(
            F.min("okey").alias("first_key"), F.max("okey").alias("last_key"), F.count_if("is_file").alias("files"),
            F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))
        begin = starts.select(F.col("bundle").alias("_bundle"), F.col("okey").alias("_okey"), F.col("part").alias("_part"))
        joined = parts.join(begin, (F.col("part") == F.col("_part")) & F.col("bundle").eqNullSafe(F.col("_bundle")), "left")
        return joined.withColumn("start", F.coalesce("_okey", F.lit("")))  # a bundle's first part begins with it

    def _frame(self, starts: list[Row]) -> DataFrame:
        return self.spark.createDataFrame([(s["bundle"], s["okey"], s["part"]) for s in starts], "bundle string, okey string, part string")

    def build(self, files: DataFrame, version: int = -1) -> None:
        """Write every bundle of ``files(bundle, path, content)`` anew."""
        keys = B.file_keys(files)
        n = keys.count()
        starts = B.range_starts(keys, max(1, -(-n // self.files_per_part))).first().starts if n else []
        starts = [Row(bundle=s["bundle"], okey=s["okey"], part=part_name((i + 1) * GAP)) for i, s in enumerate(starts)]
        starts = starts or [Row(bundle=None, okey="", part=part_name(GAP))]
        self._write(B.pack(files, **self.options), starts, None)
        self.manifest.start(self._summed(self._entries(), self._frame(starts)) if n else self.manifest.current(before=-1), version)

    def update(self, files: DataFrame, changed: DataFrame, version: int) -> int:
        """Rewrite the parts that hold ``changed(bundle, path)``, files that came, went or have other
        contents, from the current ``files(bundle, path, content)`` of their bundles. Returns the number
        of parts written. The same version again gives the same parts."""
        hits = changed.select(F.col("bundle").alias("_hit")).distinct()
        same = F.col("bundle").eqNullSafe(F.col("_hit"))
        files = files.join(hits, same, "left_semi")
        paths = files.select("bundle", "path")
        present = {r.bundle for r in paths.select("bundle").distinct().collect()}
        known = self.manifest.current(before=version).join(hits, same, "left_semi").select("bundle", "part", F.col("start").alias("okey")).collect()
        fresh = present - {r.bundle for r in known}
        parts = sorted([*known, *[Row(bundle=b, part=part_name(GAP), okey="") for b in fresh]], key=lambda r: _order(r["bundle"], r["okey"]))
        gone = [r for r in parts if r["bundle"] not in present]  # nothing of their bundles is left
        parts = [r for r in parts if r["bundle"] in present]
        alive = changed.join(paths.select(F.col("bundle").alias("_alive")).distinct(), F.col("bundle").eqNullSafe(F.col("_alive")), "left_semi")
        written, emptied = self._rewrite(files, paths, alive, parts, fresh) if parts else ([], [])
        self._log(version, written, gone + emptied)
        return len(written)

    def _rewrite(self, files: DataFrame, paths: DataFrame, changed: DataFrame, parts: list[Row], fresh: set) -> tuple[list[Row], list[Row]]:
        """Write the parts that hold changed keys; those that have blocks, and those that have none now."""
        at = {r._range for r in B.with_range(B.file_keys(changed), parts).select("_range").distinct().collect()}
        at |= {i for i, p in enumerate(parts) if p["bundle"] in fresh}
        counts = self._counts(paths, parts, at)
        large = {i: n for i, n in counts.items() if n > 2 * self.files_per_part}
        if large:
            parts, at = self._split(paths, parts, at, large)
            counts = self._counts(paths, parts, at)
        first = {i for i, p in enumerate(parts) if i == 0 or parts[i - 1]["bundle"] != p["bundle"]}
        filled = sorted(i for i in at if i in counts or i in first)  # a bundle's first part has its header
        if filled:
            self._write(B.pack(files, **self.options), parts, filled)
        return [parts[i] for i in filled], [parts[i] for i in sorted(at.difference(filled))]

    def _counts(self, paths: DataFrame, parts: list[Row], at: set[int]) -> dict[int, int]:
        routed = B.with_range(B.file_keys(paths), parts).where(F.col("_range").isin(sorted(at)))
        return {r["_range"]: r["count"] for r in routed.groupBy("_range").count().collect()}

    def _split(self, paths: DataFrame, parts: list[Row], at: set[int], large: dict[int, int]) -> tuple[list[Row], set[int]]:
        """The parts with further starts inside large ones, as far as free names allow."""
        keys = B.with_range(B.file_keys(paths), parts).where(F.col("_range").isin(sorted(large)))
        cuts = B.range_starts(keys, sum(-(-n // self.files_per_part) for n in large.values())).first().starts
        order = [_order(p["bundle"], p["okey"]) for p in parts]
        inside: dict[int, list[str]] = {}
        for c in cuts:
            i = bisect_left(order, _order(c["bundle"], c["okey"])) - 1
            if i in large and order[i] < _order(c["bundle"], c["okey"]) and parts[i]["bundle"] == c["bundle"]:
                inside.setdefault(i, []).append(c["okey"])
        out, touched = [], set()
        for i, p in enumerate(parts):
            low = int(p["part"])
            follows = i + 1 < len(parts) and parts[i + 1]["bundle"] == p["bundle"]
            more = inside.get(i, [])
            room = (int(parts[i + 1]["part"]) if follows else low + GAP * (len(more) + 1)) - low
            more = more[:max(0, room - 1)]
            for k, okey in enumerate([p["okey"], *more]):
                if i in at:
                    touched.add(len(out))
                out.append(Row(bundle=p["bundle"], part=part_name(low + room * k // (len(more) + 1)), okey=okey))
        return out, touched

    def _log(self, version: int, written: list[Row], gone: list[Row]) -> None:
        frame = self._frame([Row(bundle=r["bundle"], okey=r["okey"], part=r["part"]) for r in written])
        keys = frame.select(F.col("bundle").alias("_b"), F.col("part").alias("_p"))
        mine = F.col("bundle").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p"))
        entries = self._entries().where(F.col("part").isin([r["part"] for r in written])).join(keys, mine, "left_semi")
        rows = self._summed(entries, frame).withColumn("gone", F.lit(False)) if written else None
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        lost = self.spark.createDataFrame([(r["bundle"], r["part"]) for r in gone], "bundle string, part string")
        lost = lost.select(*[F.col(n) if n in ("bundle", "part") else F.lit(None).alias(n) for n in names], F.lit(True).alias("gone"))
        self.manifest.append(version, lost if rows is None else rows.select(*names, "gone").unionByName(lost))
        self._delete(gone)

    def _delete(self, gone: list[Row]) -> None:
        """Remove the files of parts that a change has emptied."""
        for area in ("text", "index") if gone else ():
            for name in self._located(area, gone):
                fs, path = self._open(name)
                fs.delete(path, False)

    def _located(self, area: str, parts: list[Row]) -> list[str]:
        """The files of some parts."""
        keys = self._frame([Row(bundle=r["bundle"], okey="", part=r["part"]) for r in parts]).withColumnsRenamed({"bundle": "_b", "part": "_p"})
        rows = self._rows(area).where(F.col("part").isin([r["part"] for r in parts])).select("bundle", "part", F.col("_metadata.file_path").alias("file"))
        same = F.col("bundle").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p"))
        return sorted(r.file for r in rows.join(keys, same, "left_semi").select("file").distinct().collect())

    def _open(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    # ------------------------------------------------------------------ reading

    def parts(self) -> DataFrame:
        """The manifest."""
        return self.manifest.current()

    def stats(self) -> DataFrame:
        """Files, lines, characters and KB of each bundle, from the manifest."""
        agg = self.parts().groupBy("bundle").agg(
            F.sum("files").alias("n_files"), (F.sum("lines") + 1).alias("n_lines"), F.sum("chars").alias("n_chars"))
        return agg.withColumn("kb", F.bround(F.col("n_chars") / 1024.0, 1))

    def index(self) -> DataFrame:
        """``(bundle, part, path, is_file, bytes, lines, chars, md5, offset, at)`` of each block: its byte
        offset in the part's file and in the whole bundle."""
        earlier = Window.partitionBy("bundle").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
        listed = self.parts().select(F.col("bundle").alias("_b"), F.col("part").alias("_p"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_before"))
        entries = self._entries().join(listed, F.col("bundle").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")))
        within = Window.partitionBy("bundle", "part").orderBy("okey").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum("bytes").over(within), F.lit(0))
        return entries.withColumn("offset", offset).withColumn("at", F.col("_before") + F.col("offset")).drop("_b", "_p", "_before")

    def read_block(self, bundle: str | None, path: str) -> str:
        """One file's block, read from its part by its range and checked."""
        e = self.index().where(F.col("bundle").eqNullSafe(F.lit(bundle)) & (F.col("path") == path)).first()
        if e is None:
            raise KeyError(path)
        fs, place = self._open(self._located("text", [Row(bundle=bundle, part=e.part)])[0])
        stream = fs.open(place)
        try:
            stream.seek(e.offset)
            data = bytes(stream.readNBytes(e.bytes))
        finally:
            stream.close()
        if hashlib.md5(data).hexdigest() != e.md5:
            raise ValueError(f"{path}: the stored block is damaged")
        return data.decode("utf-8")

    def read_blocks(self, wanted: DataFrame) -> DataFrame:
        """``(bundle, path, block)`` of the wanted ``(bundle, path)``, cut out of their parts' files."""
        want = wanted.select(F.col("bundle").alias("_b"), F.col("path").alias("_w")).distinct()
        found = self.index().join(want, F.col("bundle").eqNullSafe(F.col("_b")) & (F.col("path") == F.col("_w"))).drop("_b", "_w")
        raw = self._load("text", "binaryFile", "path string, modificationTime timestamp, length long, content binary")
        raw = raw.select(F.col("bundle").alias("_b"), F.col("part").alias("_p"), "content")
        located = found.join(raw, F.col("bundle").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")))
        block = F.decode(F.substring("content", (F.col("offset") + 1).cast("int"), F.col("bytes").cast("int")), "UTF-8")
        return located.select("bundle", "path", block.alias("block"))
