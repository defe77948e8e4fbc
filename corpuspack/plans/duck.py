"""DuckDB spellings of the column functions, for the oracle queries."""

from __future__ import annotations

from collections.abc import Sequence

from corpuspack.functions import text as T
from corpuspack.functions.patterns import _STRIP_WS
from corpuspack.functions.paths import duck_tree_key

NL = "chr(10)"


def sq(s: str) -> str:
    """SQL string literal (standard quoting; DuckDB does not treat backslashes)."""
    return "'" + s.replace("'", "''") + "'"


def name(path: str = "path") -> str:
    return f"string_split({path}, '/')[-1]"


def parent(path: str = "path") -> str:
    return f"regexp_extract({path}, {sq(r'(?s)\A(.*)/')}, 1)"


def ext(path: str = "path") -> str:
    return f"regexp_extract({name(path)}, {sq(T.EXT_RE)}, 1)"


def rel(path: str = "path", root: str = "bundle") -> str:
    return f"CASE WHEN starts_with({path}, {root} || '/') THEN substr({path}, length({root}) + 2) ELSE {path} END"


def ancestors(path: str = "path", include_self: str | None = None) -> str:
    parts = f"string_split({path}, '/')"
    proper = f"list_transform(range(1, len({parts})), lambda i: array_to_string({parts}[1:i], '/'))"
    if include_self is None:
        return proper
    return f"CASE WHEN {include_self} THEN list_append({proper}, {path}) ELSE {proper} END"


# The queries' globs with sets, written out by hand (the library's own compiler stays out of
# the oracles); globs without sets go to DuckDB's GLOB.
SET_GLOBS = {
    "src1[0-3]/fr/": r"src1(0|1|2|3)/fr/",
    "*/[!e]?/*[0-4].rs": r".*/[^e]./.*(0|1|2|3|4)\.rs",
    "*/[de][!e]/*": r".*/(d|e)[^e]/.*",
    "*[0-3][!0-5].[a-c]*": r".*(0|1|2|3)[^0-5]\.(a|b|c).*",
    "src[2-5]/*/m*[]7].?s": r"src(2|3|4|5)/.*/m.*(\]|7)\..s",
    "*[z-a]*": r"[^\x00-\x{10ffff}]",  # an empty set: nothing
    "*[!]*": r".*\[!\].*",  # no set, as it never closes
    "*[*": r".*\[.*",
}


def any_glob(col: str, patterns: Sequence[str]) -> str:
    if not patterns:
        return "false"
    return "(" + " OR ".join(
        f"regexp_full_match({col}, {sq('(?s)' + SET_GLOBS[p])})" if "[" in p else f"({col} GLOB {sq(p)})" for p in patterns) + ")"


def contains_any(col: str, kws: Sequence[str]) -> str:
    if not kws:
        return "false"
    return "(" + " OR ".join(f"contains({col}, {sq(k)})" for k in kws) + ")"


def hidden(path: str = "path", is_dir: str = "is_dir", hide: Sequence[str] = ()) -> str:
    by_name = (
        f"len(list_filter(string_split({path}, '/'), lambda c: starts_with(c, '.') OR {any_glob('c', hide)})) > 0"
    )
    if not hide:
        return f"({by_name})"
    by_dir = f"len(list_filter({ancestors(path, is_dir)}, lambda a: {any_glob("(a || '/')", hide)})) > 0"
    return f"({by_name} OR {by_dir})"


def strip_comments(text: str, e: str) -> str:
    hashes = ", ".join(sq(x) for x in T.HASH_EXTS)
    slashes = ", ".join(sq(x) for x in T.SLASH_EXTS)
    return (
        f"CASE WHEN {e} IN ({hashes}) THEN regexp_replace({text}, {sq(T.DUCK_COMMENT_HASH_RE)}, '', 'g') "
        f"WHEN {e} IN ({slashes}) THEN regexp_replace({text}, {sq(T.DUCK_COMMENT_SLASH_RE)}, '', 'g') "
        f"ELSE {text} END"
    )


def remove_docstrings(text: str) -> str:
    return f"regexp_replace({text}, {sq(T.DUCK_DOCSTRING_RE)}, '', 'g')"


def transform(text: str, e: str, remove_comments: bool, remove_docstrings_: bool) -> str:
    out = text
    if remove_docstrings_:
        out = f"(CASE WHEN {e} = '.py' THEN {remove_docstrings(out)} ELSE {out} END)"
    if remove_comments:
        out = f"({strip_comments(out, e)})"
    if out == text:
        return text
    return f"(CASE WHEN {e} <> '' THEN {out} ELSE {text} END)"


def comment_prefix(e: str) -> str:
    slashes = ", ".join(sq(x) for x in T.SLASH_EXTS)
    return f"(CASE WHEN {e} IN ({slashes}) THEN '//' ELSE '#' END)"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {NL}, '')))"


def parse_patterns(s: str) -> str:
    strip = "^" + _STRIP_WS + "+|" + _STRIP_WS + r"+\z"
    return (
        f"list_filter(list_transform(string_split({s}, ','), lambda x: regexp_replace(x, {sq(strip)}, '', 'g')),"
        f" lambda x: x <> '')"
    )


def tree_key(path: str, is_dir: str = "false") -> str:
    return duck_tree_key(path, is_dir)


def blocks_cte(src: str = "files", remove_comments: bool = False, remove_docstrings_: bool = False,
               text: str = "content", okey: str | None = None) -> str:
    """SELECT text producing (bundle, okey, path, is_file, block) for header and file rows."""
    body = transform(text, "ext", remove_comments, remove_docstrings_)
    ok = okey or tree_key("rel")
    return f"""
SELECT bundle, {ok} AS okey, path, true AS is_file,
  '# ==== BEGIN FILE: ' || rel || ' ====' || {NL} || {body} || {NL} || '# ==== END FILE: ' || rel || ' ====' || {NL} || {NL} AS block
FROM (SELECT *, {rel()} AS rel, {ext()} AS ext FROM {src}) f
WHERE {text} IS NOT NULL
UNION ALL
SELECT DISTINCT bundle, '' AS okey, NULL AS path, false AS is_file,
  '# Files combined from: ' || bundle || {NL} || {NL} AS block
FROM {src}
"""
