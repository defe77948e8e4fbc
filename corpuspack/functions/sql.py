"""The transforms as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``).

SQL functions are inlined by the analyzer, so calls from SQL stay native expressions.
Globs stay Python-side (compiled once on the driver, see ``patterns``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpuspack.functions import text as T


def _lit(s: str) -> str:
    """Spark SQL string literal (backslash escapes are on by default)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(exts) -> str:
    return ", ".join(_lit(e) for e in exts)


def _strip(t: str, e: str) -> str:
    return (
        f"CASE WHEN {e} IN ({_in(T.HASH_EXTS)}) THEN regexp_replace({t}, {_lit(T.COMMENT_HASH_RE)}, '') "
        f"WHEN {e} IN ({_in(T.SLASH_EXTS)}) THEN regexp_replace({t}, {_lit(T.COMMENT_SLASH_RE)}, '') "
        f"ELSE {t} END"
    )


def _nodoc(t: str) -> str:
    return f"regexp_replace({t}, {_lit(T.DOCSTRING_RE)}, '')"


def register_sql_functions(spark: SparkSession) -> None:
    doc_step = f"CASE WHEN rd AND ext = '.py' THEN {_nodoc('t')} ELSE t END"
    stmts = [
        f"CREATE OR REPLACE TEMPORARY FUNCTION file_ext(name STRING) RETURNS STRING "
        f"RETURN regexp_extract(name, {_lit(T.EXT_RE)}, 1)",
        f"CREATE OR REPLACE TEMPORARY FUNCTION comment_prefix(ext STRING) RETURNS STRING "
        f"RETURN CASE WHEN ext IN ({_in(T.SLASH_EXTS)}) THEN '//' ELSE '#' END",
        f"CREATE OR REPLACE TEMPORARY FUNCTION strip_comments(t STRING, ext STRING) RETURNS STRING "
        f"RETURN {_strip('t', 'ext')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION remove_docstrings(t STRING) RETURNS STRING RETURN {_nodoc('t')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION transform_source(t STRING, ext STRING, rc BOOLEAN, rd BOOLEAN) "
        f"RETURNS STRING RETURN CASE WHEN ext = '' THEN t "
        f"WHEN rc THEN {_strip('(' + doc_step + ')', 'ext')} ELSE {doc_step} END",
    ]
    for s in stmts:
        spark.sql(s)
