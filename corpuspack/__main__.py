"""Run a pack or a watch as a Spark job.

    spark-submit -m corpuspack pack --tree /data/repo --out /data/bundles --select '*.py' \
        --ignore --strip-comments
    python -m corpuspack pack --files /tables/files --out /tables/bundles --select
    python -m corpuspack watch --files /tables/files --events /tables/changes --out ... --state ... --once
    python -m corpuspack watch --tree /data/repo --out /data/bundles --state /data/state --select
    python -m corpuspack watch --tree /data/repo --out /data/store --state /data/state --select --parts
    python -m corpuspack export --out /data/bundles --bundle repo --to /data/repo.txt

``--files`` is a table with ``bundle, path, content``; ``--tree`` lists a folder (the
bundle is the folder's name). ``--ignore`` / ``--select`` take comma-separated globs; given
without a value they mean ``__pycache__,*.meta`` / ``*.py``. ``watch`` goes on until it is
stopped (``--once``: until what is there is done); with the same ``--state`` folder it resumes.
A watched ``--tree`` without ``--events`` is polled; all changes of a poll count. ``--parts`` keeps the
bundles in parts with an index, and a change rewrites only the parts that hold it. ``export`` joins the
parts of one bundle into one file.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions.patterns import DEFAULT_HIDE, DEFAULT_SELECT, parse_patterns
from corpuspack.functions.text import read_text
from corpuspack.operators import bundle as B
from corpuspack.operators import selection as S
from corpuspack.session import materialize, ship
from corpuspack.sources.tree import list_tree, read_listed


def _args(argv=None):
    p = argparse.ArgumentParser(prog="corpuspack")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("pack", "watch"):
        a = sub.add_parser(name)
        src = a.add_mutually_exclusive_group(required=True)
        src.add_argument("--files", help="table with bundle, path, content")
        src.add_argument("--tree", help="folder to list and read")
        a.add_argument("--format", default="parquet")
        a.add_argument("--out", required=True)
        a.add_argument("--ignore", nargs="?", const=True, default=None, help="hide globs")
        a.add_argument("--select", nargs="?", const=True, default=None, help="select globs")
        a.add_argument("--strip-comments", action="store_true")
        a.add_argument("--remove-docstrings", action="store_true")
        if name == "watch":
            a.add_argument("--events", help="folder of change_events files")
            a.add_argument("--state", required=True, help="folder that keeps the watch's state between runs")
            a.add_argument("--every", type=float, default=2.0, help="seconds between polls of a tree")
            a.add_argument("--gap", type=float, default=0.5)
            a.add_argument("--ignore-names", default="")
            a.add_argument("--ignore-paths", default="")
            a.add_argument("--include-names", default="")
            a.add_argument("--extension", help="only changes of files with this ending")
            a.add_argument("--parts", action="store_true", help="rewrite parts instead of bundles")
            a.add_argument("--files-per-part", type=int, default=10_000)
            a.add_argument("--once", action="store_true", help="process what is there, then stop")
    a = sub.add_parser("export")
    a.add_argument("--out", required=True, help="where the bundles were written to")
    a.add_argument("--bundle", required=True)
    a.add_argument("--to", required=True, help="the file to write")
    a.add_argument("--parts", action="store_true", help="the bundles are kept in parts")
    return p.parse_args(argv)


def _paths(spark, a) -> DataFrame:
    """``(bundle, path)`` and, of a tree, where each file lies; hidden parts aren't entered."""
    if a.files:
        return spark.read.format(a.format).load(a.files)
    name = os.path.basename(os.path.normpath(a.tree))
    out = os.path.relpath(os.path.abspath(a.out), os.path.abspath(a.tree))
    listed = list_tree(spark, a.tree, read_content=False, hide=parse_patterns(a.ignore, DEFAULT_HIDE),
                       exclude=[] if out.startswith("..") else [out])
    return listed.where(~F.col("is_dir")).select(
        F.lit(name).alias("bundle"), F.concat(F.lit(name + "/"), "path").alias("path"), F.col("path").alias("at"))


def _files(spark, a, selection: DataFrame | None = None) -> DataFrame:
    """``(bundle, path, content)``; of a tree only the selected files are read."""
    rows = _paths(spark, a)
    if a.files:
        return rows
    if selection is not None:
        rows = S.keep_selected(rows, selection)
    read = read_listed(rows.select("bundle", F.col("path").alias("shown"), F.col("at").alias("path")), a.tree)
    return read.select("bundle", F.col("shown").alias("path"), read_text(F.col("content")).alias("content"))


def main(argv=None) -> None:
    a = _args(argv)
    spark = SparkSession.builder.appName(f"corpuspack-{a.cmd}").getOrCreate()
    ship(spark)
    if a.cmd == "export":
        place = a.out.rstrip("/") + ("/data/area=text" if a.parts else "")
        print(json.dumps({"bytes": B.export_bundle(spark, place, a.bundle, a.to)}))
        return
    hide = parse_patterns(a.ignore, DEFAULT_HIDE)
    select = parse_patterns(a.select, DEFAULT_SELECT)
    options = {"remove_comments": a.strip_comments, "remove_docstrings": a.remove_docstrings}
    selection = S.select_glob(S.visible_files(_paths(spark, a), hide), select)
    if a.cmd == "pack":
        selection = materialize(selection, "selection")
        stats = B.build_bundles(S.visible_files(_files(spark, a, selection), hide), selection, a.out, **options)
        if stats is None:
            print(json.dumps({"bundles": 0, "note": "no files selected; nothing written"}))
            return
        total = stats.agg(F.count(F.lit(1)).alias("bundles"), F.sum("n_lines").alias("lines"),
                          F.sum("n_chars").alias("chars")).first()
        print(json.dumps(total.asDict()))
        return
    from corpuspack.streaming import watch as W

    state = a.state.rstrip("/")
    # a new DataFrame each time: an old one keeps the list of files of its day
    if a.parts:
        rebuild = W.PartRebuilder(lambda: _files(spark, a), selection, a.out, state, hide=hide, files_per_part=a.files_per_part,
                                  select=lambda files: S.select_glob(files, select), **options)
    else:
        rebuild = W.BundleRebuilder(lambda: _files(spark, a), selection, a.out, state, hide=hide, **options)
    polled = a.tree and not a.events
    if polled:
        W.poll_tree(spark, a.tree, state, hide=hide)
    rebuild.build_all(spark)
    schema = "event_id long, ts timestamp, root string, path string, kind string, is_directory boolean"
    folder = f"{state}/events" if polled else a.events
    if polled:
        spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    events = spark.readStream.schema(schema).parquet(folder)
    q = W.watch(events, rebuild, extension=a.extension, coalesce=bool(polled or a.parts), ignore_names=parse_patterns(a.ignore_names),
                ignore_paths=parse_patterns(a.ignore_paths), include_names=parse_patterns(a.include_names),
                gap_seconds=a.gap, checkpoint=f"{state}/checkpoint",
                trigger={"availableNow": True} if a.once else None)
    while polled and not a.once and not q.awaitTermination(a.every):
        W.poll_tree(spark, a.tree, state, hide=hide)
    q.awaitTermination()


if __name__ == "__main__":
    main()
