"""Transforms over file tables and line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.functions import paths as P
from corpuspack.functions import text as T


def transform_files(files: DataFrame, text_col: str = "content", remove_comments: bool = False,
                    remove_docstrings: bool = False) -> DataFrame:
    """Replace ``text_col`` by its transformed text (per-row native regex, no shuffle)."""
    ext = T.extension(P.base_name(F.col("path")))
    return files.withColumn(text_col, T.transform_source(F.col(text_col), ext, remove_comments, remove_docstrings))


def explode_lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """``lines(path, pos, line)``: one row per line, each keeping its newline."""
    return files.select("path", F.posexplode(T.split_lines(text_col)).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("bigint"))


def transform_lines(lines: DataFrame, remove_comments: bool = False, remove_docstrings: bool = False) -> DataFrame:
    """Line-table form: ``lines(path, pos, line)`` in, the kept lines renumbered out.

    The lines of one file are put back together (one file is the unit the rules work on,
    as a whole file is read at once by the original tool), transformed with the same
    native expressions, and split again.
    """
    texts = lines.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
        .alias("text"))
    return explode_lines(transform_files(texts, "text", remove_comments, remove_docstrings), "text")


def with_comment_prefix(files: DataFrame, syntax: DataFrame | None = None, default: str = T.DEFAULT_PREFIX) -> DataFrame:
    """Add ``ext`` and ``prefix``: from the built-in table, or from a user table
    ``syntax(ext, prefix)`` joined on the extension."""
    df = files.withColumn("ext", T.extension(P.base_name(F.col("path"))))
    if syntax is None:
        return df.withColumn("prefix", T.comment_prefix("ext"))
    table = syntax.select(F.col("ext").alias("_ext"), F.col("prefix").alias("_prefix")).dropDuplicates(["_ext"])
    joined = df.join(table, df["ext"] == table["_ext"], "left")
    return joined.withColumn("prefix", F.coalesce("_prefix", F.lit(default))).drop("_ext", "_prefix")
