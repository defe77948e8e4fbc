"""Schemas of the tables the operators read and write."""

from pyspark.sql import types as T

FILES_SCHEMA = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

RAW_FILES_SCHEMA = T.StructType([
    T.StructField("bundle", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("bytes", T.BinaryType()),
])

NODES_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
])

CHANGE_EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("root", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("is_directory", T.BooleanType()),
])

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
])

TREE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("length", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("content", T.BinaryType()),
])
