"""File tables: reading, strict decoding, the reject channel and explicit path lists.

At scale the corpus is a table ``files(bundle, path, content)`` (parquet or any table
source; ``content`` as text or raw bytes). Selections never touch ``content``, so column
pruning keeps it out of their scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from corpuspack.schema import FILES_SCHEMA


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A file table with the ``files`` schema (``content`` may be string or binary)."""
    return spark.read.format(fmt).load(path)


def list_store(spark: SparkSession, uri: str, read_content: bool = True) -> DataFrame:
    """Files below a folder of any storage that Spark reads (an object store, a cluster file
    system), in the schema of a listed tree: paths relative to ``uri``, no directories. Spark
    leaves out names that start with ``_`` or ``.``; where those count, list a mounted tree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(uri)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    path = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    return found.select(path.alias("path"), F.lit(False).alias("is_dir"), F.col("length"), F.col("modificationTime").alias("mtime"),
                        (F.col("content") if read_content else F.lit(None).cast("binary")).alias("content"))


def decode_files(raw: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """Decode raw bytes like a strict UTF-8 text-mode read; ``text`` is NULL when invalid."""
    return raw.withColumn("text", T.read_text(F.col(bytes_col))).drop(bytes_col)


def rejects_undecodable(decoded: DataFrame, text_col: str = "text") -> DataFrame:
    """Files that could not be read as UTF-8 (they are skipped and not counted)."""
    return decoded.where(F.col(text_col).isNull()).select(
        "bundle", "path", F.lit("not valid UTF-8").alias("reason")
    )


def explicit_list(files: DataFrame, paths: DataFrame, dirs: DataFrame | None = None,
                  text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Resolve a caller's ordered list ``paths(bundle, seq, path)`` against ``files``.

    Returns ``(found, rejects)``: ``found`` keeps every list entry (order key ``seq``,
    duplicates kept) with the file's text; ``rejects`` lists entries that are directories
    (``dirs(path)``), do not exist, or have no text because their bytes are not valid UTF-8.
    Which entries exist is asked of the paths alone.
    """
    found = paths.join(files.where(F.col(text_col).isNotNull()).select("path", text_col), "path")
    missing = paths.join(files.select("path").distinct(), "path", "left_anti")
    if dirs is not None:
        d = dirs.select("path").distinct().withColumn("_is_dir", F.lit(True))
        missing = missing.join(d, "path", "left")
        reason = F.when(F.col("_is_dir"), F.lit("is a directory")).otherwise(F.lit("not found"))
    else:
        reason = F.lit("not found")
    unread = files.where(F.col(text_col).isNull()).select("path").distinct()
    rejects = missing.select("bundle", "seq", "path", reason.alias("reason")).unionByName(
        paths.join(unread, "path", "left_semi").select("bundle", "seq", "path", F.lit("not valid UTF-8").alias("reason")))
    return found, rejects


def seq_key(seq_col: str = "seq"):
    """Order key for list positions: zero-padded so string order equals numeric order."""
    return F.lpad(F.col(seq_col).cast("string"), 20, "0")


__all__ = ["FILES_SCHEMA", "read_files", "list_store", "decode_files", "rejects_undecodable", "explicit_list", "seq_key"]
