"""Pack files into bundles: per-file blocks, bundle headers, statistics and the ordered sink.

A bundle is never built as one string. It is a set of block rows with an order key; the
sink range-partitions on ``(bundle, okey)`` and writes each range as a part file, so the
part files of a bundle, read in name order, are the bundle byte for byte. Statistics are
sums over blocks (distributive), so they need neither the packed text nor a sort.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpuspack.functions import paths as P
from corpuspack.functions import text as T


def _lit_fmt(fmt: str, prefix: Column, **cols: Column) -> Column:
    """Build ``fmt`` (``{p}`` and named fields) as a concat of literals and columns."""
    import re

    pieces: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", fmt):
        if m.start() > pos:
            pieces.append(F.lit(fmt[pos:m.start()]))
        key = m.group(1)
        pieces.append(prefix if key == "p" else cols[key])
        pos = m.end()
    if pos < len(fmt):
        pieces.append(F.lit(fmt[pos:]))
    return F.concat(*pieces)


def with_file_columns(files: DataFrame, root: str | Column = "bundle") -> DataFrame:
    """Add ``rel`` (path relative to the bundle root), ``name`` and ``ext``."""
    root_c = F.col(root) if isinstance(root, str) else root
    return (
        files.withColumn("rel", P.relative_to(F.col("path"), root_c))
        .withColumn("name", P.base_name(F.col("path")))
        .withColumn("ext", T.extension(F.col("name")))
    )


def _block(text_col: str, remove_comments: bool, remove_docstrings: bool, marker: str) -> Column:
    """The block of a row that has its file columns."""
    body = T.transform_source(F.col(text_col), F.col("ext"), remove_comments, remove_docstrings)
    prefix = T.comment_prefix(F.col("ext")) if marker == "by_extension" else F.lit(marker)
    rel = F.col("rel")
    return F.concat(_lit_fmt(T.BEGIN_FMT, prefix, path=rel), body, _lit_fmt(T.END_FMT, prefix, path=rel))


def file_blocks(files: DataFrame, *, text_col: str = "content", remove_comments: bool = False,
                remove_docstrings: bool = False, marker: str = "#", root: str | Column = "bundle",
                order: str | Column | None = None) -> DataFrame:
    """One block per file row: BEGIN marker, transformed text, END marker.

    ``files`` needs ``bundle``, ``path`` and a decoded text column (NULL rows are dropped:
    they belong to the reject channel). ``marker='by_extension'`` uses the comment prefix of
    each file's extension instead of '#'. ``order`` overrides the tree order key (e.g. a
    caller's list position).
    """
    df = with_file_columns(files, root).where(F.col(text_col).isNotNull())
    block = _block(text_col, remove_comments, remove_docstrings, marker)
    okey = P.tree_key(F.col("rel")) if order is None else (F.col(order) if isinstance(order, str) else order)
    return df.select(
        "bundle", okey.alias("okey"), F.col("path"), F.lit(True).alias("is_file"), block.alias("block")
    )


def _header(marker: str, root: str | Column) -> Column:
    """Header text: the source root, or the bundle's id where that is empty (nothing for a NULL one)."""
    root_c = F.col(root) if isinstance(root, str) else root
    shown = F.when(F.length(root_c) > 0, root_c).otherwise(F.coalesce(F.col("bundle").cast("string"), F.lit("")))
    return _lit_fmt(T.HEADER_FMT, F.lit(marker if marker != "by_extension" else "#"), root=shown)


def header_blocks(files: DataFrame, marker: str = "#", root: str | Column = "bundle") -> DataFrame:
    """One header row per bundle (order key '' sorts before every file). Reads no content."""
    header = _header(marker, root)
    return files.select("bundle").distinct().select(
        "bundle", F.lit("").alias("okey"), F.lit(None).cast("string").alias("path"),
        F.lit(False).alias("is_file"), header.alias("block"),
    )


def pack(files: DataFrame, **kw) -> DataFrame:
    """Header and file blocks of every bundle (unordered rows; order by ``okey``)."""
    return header_blocks(files, kw.get("marker", "#"), kw.get("root", "bundle")).unionByName(file_blocks(files, **kw))


def pack_stats(files: DataFrame, *, text_col: str = "content", remove_comments: bool = False,
               remove_docstrings: bool = False, marker: str = "#", root: str | Column = "bundle") -> DataFrame:
    """Files, lines, characters and KB of every bundle in one pass over the files. The header's
    size is added per bundle; a bundle whose files are all rejected is its header."""
    df = with_file_columns(files, root)
    block = _block(text_col, remove_comments, remove_docstrings, marker)  # NULL where the text is
    agg = df.groupBy("bundle").agg(
        F.count(text_col).cast("bigint").alias("n_files"), F.sum(T.newline_count(block)).alias("_lines"),
        F.sum(T.char_count(block)).alias("_chars"), *([] if isinstance(root, str) else [F.first(root).alias("_root")]))
    header = _header(marker, root if isinstance(root, str) else F.col("_root"))
    out = agg.select(
        "bundle", "n_files",
        (F.coalesce("_lines", F.lit(0)) + T.newline_count(header) + 1).cast("bigint").alias("n_lines"),
        (F.coalesce("_chars", F.lit(0)) + T.char_count(header)).cast("bigint").alias("n_chars"))
    return out.withColumn("kb", F.bround(F.col("n_chars") / 1024.0, 1))


def block_summary(blocks: DataFrame) -> DataFrame:
    """Blocks with their size columns instead of the text (for checks and reports)."""
    return blocks.select(
        "bundle", "okey", "path", "is_file",
        T.char_count("block").alias("n_chars"),
        T.newline_count("block").alias("n_newlines"),
        F.md5("block").alias("block_md5"),
    )


def bundle_stats(blocks: DataFrame) -> DataFrame:
    """Files, lines, characters and KB per bundle, summed over blocks (partial aggregation
    on the map side, so a huge bundle costs one row per task in the shuffle)."""
    agg = blocks.groupBy("bundle").agg(
        F.count_if(F.col("is_file")).cast("bigint").alias("n_files"),
        (F.sum(T.newline_count("block")) + 1).cast("bigint").alias("n_lines"),
        F.sum(T.char_count("block")).cast("bigint").alias("n_chars"),
    )
    return agg.withColumn("kb", F.bround(F.col("n_chars") / 1024.0, 1))


def processed_count(blocks: DataFrame) -> DataFrame:
    return blocks.where("is_file").groupBy("bundle").agg(F.count(F.lit(1)).alias("n_processed"))


#: Sampled keys per range: a range's size is within about a quarter of the mean.
KEYS_PER_RANGE = 16


def range_starts(keys: DataFrame, num_ranges: int) -> DataFrame:
    """One row with the sorted first keys ``(bundle, okey)`` of at most ``num_ranges`` even ranges.

    The bounds are quantiles of the keys whose hash lies below a threshold: a sketch that is merged by
    union, so nothing but its ``KEYS_PER_RANGE * num_ranges`` keys (fewer if there are fewer) leaves the
    tasks that read the table. The threshold comes from the number of keys. Equal keys hash alike, so
    the sketch, and with it the ranges, are the same in each run.
    """
    total = keys.agg(F.count(F.lit(1))).scalar()
    place = F.shiftrightunsigned(F.xxhash64("bundle", "okey"), 11) / F.lit(float(1 << 53))  # even in [0, 1)
    sketch = keys.where(place * total < KEYS_PER_RANGE * num_ranges)
    ordered = sketch.agg(F.sort_array(F.collect_list(F.struct("bundle", "okey"))).alias("k"))
    m = F.size("k").cast("long")
    n = F.least(m, F.lit(num_ranges))
    firsts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("k", F.floor(i * m / n).cast("int")))
    return ordered.select(F.when(m > 0, firsts).otherwise(F.slice("k", 1, 0)).alias("starts"))


def with_range(df: DataFrame, starts: Sequence[Row], name: str = "_range") -> DataFrame:
    """Adds the number of the range that a row's ``(bundle, okey)`` lies in: the last start that isn't
    greater, searched by halving, so that a row costs the logarithm of the number of ranges. The starts
    are one constant of the plan, not a column."""
    listed = json.dumps([{"bundle": s["bundle"], "okey": s["okey"]} for s in starts])
    table = F.from_json(F.lit(listed), "array<struct<bundle:string,okey:string>>")
    key = F.struct(F.col("bundle").cast("string").alias("bundle"), F.col("okey").alias("okey"))
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(1, len(starts).bit_length())))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))
    return df.withColumn(name, F.greatest(found - 1, F.lit(0)))


def sink_frame(blocks: DataFrame, num_ranges: int | None = None, observation=None,
               keys: DataFrame | None = None) -> DataFrame:
    """``(bundle, value)`` rows in bundle order, split into ranges of (bundle, okey).

    Each value is the block minus its final newline (the text sink adds it back). The ranges
    come from ``keys(bundle, okey)``, which need no content; the blocks themselves are made
    and shuffled once, by range number. The observation counts file blocks.
    """
    spark = blocks.sparkSession
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(blocks if keys is None else keys, n).first().starts
    rows = blocks.select("bundle", "okey", "is_file", F.expr("substring(block, 1, length(block) - 1)").alias("value"))
    ranged = with_range(rows, starts).repartitionById(n, "_range")
    if observation is not None:
        ranged = ranged.observe(observation, F.count_if(F.col("is_file")).alias("n_files"))
    return ranged.sortWithinPartitions("bundle", "okey").select("bundle", "value")


def file_keys(files: DataFrame, root: str | Column = "bundle") -> DataFrame:
    """``(bundle, okey)`` of files in tree order, from their paths alone."""
    return with_file_columns(files.select("bundle", "path"), root).select("bundle", P.tree_key(F.col("rel")).alias("okey"))


def write_bundles(blocks: DataFrame, out_dir: str, num_ranges: int | None = None, only_written: bool = False,
                  keys: DataFrame | None = None) -> int:
    """Write every bundle as ordered part files under ``out_dir/bundle=<b>/``.

    Blocks are split into ranges of (bundle, okey), so one huge bundle spreads over many
    tasks and part-file name order equals bundle order. No single task sees a whole bundle.
    ``keys`` (e.g. of :func:`file_keys`) gives the ranges without reading content.
    ``only_written`` replaces just the bundles present in ``blocks`` (dynamic partition
    overwrite); otherwise ``out_dir`` is replaced as a whole. Returns the number of file
    blocks written, observed during the write itself.
    """
    from pyspark.sql import Observation

    seen = Observation("bundle_write")
    (
        sink_frame(blocks, num_ranges, seen, keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_written else "static")
        .partitionBy("bundle")
        .text(out_dir)
    )
    return int(seen.get["n_files"])


def read_bundle_lines(spark, out_dir: str) -> DataFrame:
    """Lines of written bundles (``bundle``, ``part``, ``line``); bundle names stay strings."""
    lines = spark.read.schema("value string, bundle string").option("lineSep", "\n").text(out_dir)
    return lines.select("bundle", F.input_file_name().alias("part"), F.col("value").alias("line"))


def written_stats(spark, out_dir: str) -> DataFrame:
    """Lines and characters of written bundles; a part file is read line by line."""
    agg = read_bundle_lines(spark, out_dir).groupBy("bundle").agg(
        (F.count(F.lit(1)) + 1).cast("bigint").alias("n_lines"),
        F.sum(T.char_count("line") + 1).cast("bigint").alias("n_chars"),
    )
    return agg.withColumn("kb", F.bround(F.col("n_chars") / 1024.0, 1))


def build_bundles(files: DataFrame, selection: DataFrame, out_dir: str, *, remove_comments: bool = False,
                  remove_docstrings: bool = False, num_ranges: int | None = None) -> DataFrame | None:
    """Pack the selected files of every bundle and write them; returns per-bundle statistics.

    Nothing is written (and ``None`` returned) when the selection is empty, so existing
    bundles stay as they are.
    """
    from corpuspack.operators.selection import keep_selected

    if selection.isEmpty():
        return None
    chosen = keep_selected(files, selection)
    blocks = pack(chosen, remove_comments=remove_comments, remove_docstrings=remove_docstrings)
    write_bundles(blocks, out_dir, num_ranges, keys=file_keys(keep_selected(files.select("bundle", "path"), selection)))
    return written_stats(files.sparkSession, out_dir)


def create_bundle(files: DataFrame, paths: DataFrame, out_dir: str, *, root: str | Column | None = None,
                  remove_comments: bool = False, remove_docstrings: bool = False,
                  dirs: DataFrame | None = None) -> tuple[int, DataFrame]:
    """Pack a caller's ordered list ``paths(bundle, seq, path)`` (duplicates kept, list
    order) from ``files(path, content)`` and write it; returns (files processed, rejects).
    Paths are shown relative to ``root``."""
    from corpuspack.sources.files import explicit_list, seq_key

    root = F.lit("") if root is None else root
    found, rejects = explicit_list(files.select("path", "content"), paths, dirs)
    blocks = file_blocks(found.withColumn("okey", seq_key()), root=root, order="okey",
                         remove_comments=remove_comments, remove_docstrings=remove_docstrings)
    header = header_blocks(paths.select("bundle").distinct(), root=root)
    n = write_bundles(header.unionByName(blocks), out_dir, keys=paths.select("bundle", seq_key().alias("okey")))
    return n, rejects


def export_bundle(spark, out_dir: str, bundle: str, target: str) -> int:
    """Join a written bundle's part files, in the order of their names, into the one file ``target``.
    The bytes are streamed from storage to storage; returns their number."""
    from urllib.parse import unquote

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(out_dir).getFileSystem(conf)
    # of several folders whose names mean the same there is only one that a write made
    found = [s.getPath() for s in fs.listStatus(place(out_dir)) if unquote(s.getPath().getName()) == f"bundle={bundle}"]
    if not found:
        raise KeyError(bundle)
    parts = []
    files = fs.listFiles(found[0], True)
    while files.hasNext():
        p = files.next().getPath()
        if p.getName().startswith("part-"):
            parts.append(p)
    end = place(target)
    out = end.getFileSystem(conf).create(end, True)
    try:
        for p in sorted(parts, key=lambda p: p.toString()):
            stream = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
        return out.getPos()
    finally:
        out.close()
