"""Text columns: decoding, line handling and the two source transforms.

Everything here is a native Spark ``Column`` expression (Java regex, whole-stage codegen);
no Python runs per row. The patterns are written for ``java.util.regex``; the DuckDB forms
used by the oracles live next to them so the two stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# Comment syntax by file extension; any other extension has no comment stripping and the
# prefix lookup falls back to "#".
COMMENT_SYNTAX = {
    ".py": "#",
    ".cs": "//",
    ".js": "//",
    ".php": "//",
    ".java": "//",
    ".c": "//",
    ".cpp": "//",
    ".ts": "//",
    ".go": "//",
    ".rb": "#",
    ".rs": "//",
    ".swift": "//",
}
DEFAULT_PREFIX = "#"
# Bundle text: header and per-file markers.
HEADER_FMT = "{p} Files combined from: {root}\n\n"
BEGIN_FMT = "{p} ==== BEGIN FILE: {path} ====\n"
END_FMT = "\n{p} ==== END FILE: {path} ====\n\n"
# ---------------------------------------------------------------------------------------

HASH_EXTS = sorted(e for e, p in COMMENT_SYNTAX.items() if p == "#")
SLASH_EXTS = sorted(e for e, p in COMMENT_SYNTAX.items() if p == "//")

# Unicode whitespace as Python's ``\s`` sees it, minus "\n" (a match must never swallow the
# end of a line). Java's \s is ASCII-only, so the class is spelled out.
WS = (
    r"[\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# One line with its "\n" kept (the last may lack it).
LINES_RE = r"([^\n]*\n|[^\n]+)"
# Full-line comments. (?d): only "\n" ends a line for ^; (?m): ^ at every line start.
COMMENT_HASH_RE = r"(?dm)^" + WS + r"*#[^\n]*(?:\n|\z)"
COMMENT_SLASH_RE = r"(?dm)^" + WS + r"*//[^\n]*(?:\n|\z)"
# Docstring lines: from the line holding the first triple quote through the line holding the
# next occurrence of the same quote (or to the end of the text when it never closes).
TQ2, TQ1 = '"' * 3, "'" * 3
DOCSTRING_RE = r"(?dm)^[^\n]*?(" + TQ2 + "|" + TQ1 + r")(?s:.*?)(?:\1[^\n]*(?:\n|\z)|\z)"
# Last suffix of a base name, dot included; none for ".a", "a." and "a".
EXT_RE = r"(?s)\A.+(\.[^.]+)\z"
NEWLINES_RE = r"\r\n?"

# RE2 (DuckDB) spellings for the oracles: no (?d) and no back-reference.
DUCK_COMMENT_HASH_RE = r"(?m)^" + WS + r"*#[^\n]*(?:\n|\z)"
DUCK_COMMENT_SLASH_RE = r"(?m)^" + WS + r"*//[^\n]*(?:\n|\z)"
DUCK_DOCSTRING_RE = (
    r"(?m)^[^\n]*?(?:"
    + TQ2 + r"(?s:.*?)(?:" + TQ2 + r"[^\n]*(?:\n|\z)|\z)|"
    + TQ1 + r"(?s:.*?)(?:" + TQ1 + r"[^\n]*(?:\n|\z)|\z))"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_utf8(raw) -> Column:
    """Strict UTF-8 decode of a binary column; NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(_col(raw).cast("string"))


def universal_newlines(text) -> Column:
    """"\\r\\n" and a lone "\\r" become "\\n", as a text-mode read does."""
    return F.regexp_replace(_col(text), NEWLINES_RE, "\n")


def read_text(raw) -> Column:
    """Bytes to text the way a strict UTF-8 text-mode open + read does; NULL if undecodable."""
    return universal_newlines(decode_utf8(raw))


def extension(name) -> Column:
    """File extension of a base name ('' when there is none)."""
    return F.regexp_extract(_col(name), EXT_RE, 1)


def comment_prefix(ext) -> Column:
    """Comment prefix for an extension, '#' by default."""
    e = _col(ext)
    return F.when(e.isin(*SLASH_EXTS), F.lit("//")).otherwise(F.lit(DEFAULT_PREFIX))


def strip_comments(text, ext) -> Column:
    """Drop full-line comments for the known extensions; other texts are returned as is."""
    t, e = _col(text), _col(ext)
    return (
        F.when(e.isin(*HASH_EXTS), F.regexp_replace(t, COMMENT_HASH_RE, ""))
        .when(e.isin(*SLASH_EXTS), F.regexp_replace(t, COMMENT_SLASH_RE, ""))
        .otherwise(t)
    )


def remove_docstrings(text) -> Column:
    """Drop triple-quoted blocks line-wise (not syntax aware, like the original tool)."""
    return F.regexp_replace(_col(text), DOCSTRING_RE, "")


def transform_source(text, ext, remove_comments: bool | Column = False,
                     remove_docstrings_: bool | Column = False) -> Column:
    """Docstrings first (``.py`` only), then comments; files without extension unchanged."""
    t, e = _col(text), _col(ext)
    rc = remove_comments if isinstance(remove_comments, Column) else F.lit(bool(remove_comments))
    rd = remove_docstrings_ if isinstance(remove_docstrings_, Column) else F.lit(bool(remove_docstrings_))
    if not isinstance(remove_comments, Column) and not isinstance(remove_docstrings_, Column):
        # Static flags: build only the expression that is needed.
        out = t
        if remove_docstrings_:
            out = F.when(e == ".py", remove_docstrings(out)).otherwise(out)
        if remove_comments:
            out = strip_comments(out, e)
        return F.when(e != "", out).otherwise(t) if out is not t else t
    after_doc = F.when(rd & (e == ".py"), remove_docstrings(t)).otherwise(t)
    after_cmt = F.when(rc, strip_comments(after_doc, e)).otherwise(after_doc)
    return F.when(e != "", after_cmt).otherwise(t)


def split_lines(text) -> Column:
    """Array of lines, each keeping its "\\n"; an empty text has no lines."""
    return F.regexp_extract_all(_col(text), F.lit(LINES_RE), 1)


def newline_count(text) -> Column:
    t = _col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("bigint")


def char_count(text) -> Column:
    return F.length(_col(text)).cast("bigint")


def transform_line_array(lines, ext, remove_comments: bool | Column = False,
                         remove_docstrings_: bool | Column = False) -> Column:
    """Array-of-lines form (each line keeps its newline): join, transform, split again."""
    joined = F.array_join(_col(lines), "")
    return split_lines(transform_source(joined, ext, remove_comments, remove_docstrings_))


def strip_comments_lines(lines, ext) -> Column:
    return split_lines(strip_comments(F.array_join(_col(lines), ""), ext))


def remove_docstrings_lines(lines) -> Column:
    return split_lines(remove_docstrings(F.array_join(_col(lines), "")))
