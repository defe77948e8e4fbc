"""Pattern lists, glob matching and keyword predicates.

Globs follow shell-style ``fnmatch`` rules on POSIX: the whole string must match, ``*`` and
``?`` also match ``/`` and newlines, ``[seq]`` / ``[!seq]`` are sets, a ``[`` without a
closing ``]`` is literal, and matching is case-sensitive. A glob is compiled once on the
driver: to ``LIKE`` when it has no set (Catalyst turns ``%x``/``x%``/``%x%`` into
``EndsWith``/``StartsWith``/``Contains`` and pushes them into the parquet scan), otherwise to
an anchored regex that Java and RE2 read the same way (every literal as ``\\x{..}``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuspack.functions.text import WS

# Python's str.strip() whitespace: the WS class plus "\n".
_STRIP_WS = WS[:-1] + r"\n]"

# What a pattern flag given without a value stands for.
DEFAULT_HIDE = "__pycache__,*.meta"
DEFAULT_SELECT = "*.py"


def parse_patterns(value, flag_default: str | None = None) -> list[str]:
    """Comma-separated string -> trimmed, non-empty list.

    ``None`` (flag absent) gives ``[]``; ``True`` (flag given without a value) parses
    ``flag_default``; a list is cleaned the same way.
    """
    if value is None or value is False:
        return []
    if value is True:
        value = flag_default or ""
    items = value.split(",") if isinstance(value, str) else list(value)
    return [p.strip() for p in items if p.strip()]


def parse_patterns_col(s) -> Column:
    """Column form of :func:`parse_patterns` for a string column."""
    c = F.col(s) if isinstance(s, str) else s
    trimmed = F.transform(
        F.split(c, ","), lambda x: F.regexp_replace(x, "^" + _STRIP_WS + "+|" + _STRIP_WS + r"+\z", "")
    )
    return F.filter(trimmed, lambda x: x != "")


# ---------------------------------------------------------------------------------------
# glob compiler

_STAR, _ANY = ("star",), ("any",)


def _hexchar(ch: str) -> str:
    return "\\x{%x}" % ord(ch)


def _set_items(body: str) -> list[tuple[str, str]]:
    """Members of a glob set body (without the leading '!') as (lo, hi) pairs, left to right.

    Three characters with '-' in the middle are a range, anything else is itself, so a '-'
    at either end or right after a range is literal. A reversed range holds nothing.
    """
    members: list[tuple[str, str]] = []
    at = 0
    while at < len(body):
        three = body[at:at + 3]
        if len(three) == 3 and three[1] == "-":
            if three[0] <= three[2]:
                members.append((three[0], three[2]))
            at += 3
        else:
            members.append((three[0], three[0]))
            at += 1
    return members


# A run of stars, any one character, a set (its first member may be ']'), a character.
_TOKEN = re.compile(r"(?P<star>\*+)|(?P<any>\?)|\[(?P<no>!?+)(?P<set>\][^\]]*|[^\]]+)\]|(?P<lit>.)", re.S)


def _tokens(pattern: str) -> list:
    out: list = []
    for m in _TOKEN.finditer(pattern):
        if m["star"]:
            out.append(_STAR)
        elif m["any"]:
            out.append(_ANY)
        elif m["set"]:
            out.append(("set", bool(m["no"]), _set_items(m["set"])))
        else:
            out.append(("lit", m["lit"]))
    return out


def glob_shape(pattern: str) -> tuple[list[str], int, str, str]:
    """A glob's runs of literal characters, the least length of what it matches, and the literal
    characters that this begins and ends with."""
    tokens = _tokens(pattern)
    runs = [""]
    for t in tokens:
        if t[0] == "lit":
            runs[-1] += t[1]
        else:
            runs.append("")
    least = sum(t is not _STAR for t in tokens)
    return [r for r in runs if r], least, runs[0], runs[-1]


def is_simple_glob(pattern: str) -> bool:
    return not any(t[0] == "set" for t in _tokens(pattern))


def can_match_trailing_slash(pattern: str) -> bool:
    """Whether the glob can match some string ending with '/' (its last token must be
    able to match '/'). Globs that cannot are skipped in the directory test."""
    toks = _tokens(pattern)
    if not toks:
        return False
    last = toks[-1]
    if last is _STAR or last is _ANY:
        return True
    if last[0] == "lit":
        return last[1] == "/"
    _, negate, items = last
    inside = any(lo <= "/" <= hi for lo, hi in items)
    return inside != negate


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for a glob; valid for both java.util.regex and RE2."""
    parts = []
    for t in _tokens(pattern):
        if t is _STAR:
            parts.append(".*")
        elif t is _ANY:
            parts.append(".")
        elif t[0] == "lit":
            parts.append(_hexchar(t[1]))
        else:
            _, negate, items = t
            if not items:
                parts.append("." if negate else r"[^\x{0}-\x{10ffff}]")
                continue
            body = "".join(
                _hexchar(lo) if lo == hi else f"{_hexchar(lo)}-{_hexchar(hi)}" for lo, hi in items
            )
            parts.append(("[^" if negate else "[") + body + "]")
    return r"(?s)\A(?:" + "".join(parts) + r")\z"


def glob_to_like(pattern: str) -> str | None:
    """LIKE pattern (escape '\\') for a glob without sets, else None."""
    toks = _tokens(pattern)
    if any(t[0] == "set" for t in toks):
        return None
    out = []
    for t in toks:
        if t is _STAR:
            out.append("%")
        elif t is _ANY:
            out.append("_")
        else:
            ch = t[1]
            out.append("\\" + ch if ch in "%_\\" else ch)
    return "".join(out)


def glob_match(col, pattern: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    like = glob_to_like(pattern)
    if like is not None:
        return c.like(like)
    return c.rlike(glob_to_regex(pattern))


def any_glob(col, patterns: Sequence[str]) -> Column:
    """True when ``col`` matches any glob; an empty list matches nothing."""
    preds = [glob_match(col, p) for p in patterns]
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


# ---------------------------------------------------------------------------------------
# keyword predicates (substring, case-sensitive)


def contains_any(col, keywords: Iterable[str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    preds = [c.contains(k) for k in keywords]
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def should_include(name, include_names: Sequence[str]) -> Column:
    """All files when the list is empty, else any keyword is a substring of the name."""
    return F.lit(True) if not include_names else contains_any(name, include_names)


def should_ignore(name, rel_path, ignore_names: Sequence[str], ignore_paths: Sequence[str]) -> Column:
    """Name keyword in the base name, or path keyword in the relative path."""
    return contains_any(name, ignore_names) | contains_any(rel_path, ignore_paths)


def keyword_filter(name, rel_path, ignore_names=(), ignore_paths=(), include_names=()) -> Column:
    """Keep rows that are not ignored and are included."""
    return ~should_ignore(name, rel_path, ignore_names, ignore_paths) & should_include(name, include_names)
