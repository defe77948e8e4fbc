"""Path columns: name, parent, parts, ancestors and the depth-first tree order key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_separators(path) -> Column:
    """Backslashes become '/' (change events from other platforms)."""
    return F.translate(_col(path), "\\", "/")


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def parent_dir(path) -> Column:
    """Parent directory ('' for a top-level entry)."""
    return F.regexp_extract(_col(path), r"(?s)\A(.*)/", 1)


def parts(path) -> Column:
    return F.split(_col(path), "/")


def depth(path) -> Column:
    return F.size(parts(path)).cast("bigint")


def relative_to(path, root) -> Column:
    """Path relative to ``root`` when it lies under it, else unchanged."""
    p, r = _col(path), _col(root)
    prefix = F.concat(r, F.lit("/"))
    return F.when(p.startswith(prefix), p.substr(F.length(prefix) + 1, F.lit(2**31 - 1))).otherwise(p)


def ancestors(path, include_self=False) -> Column:
    """Array of the proper directory prefixes of ``path`` (outermost first).

    ``include_self`` may be a bool or a boolean column (e.g. ``is_dir``).
    """
    ps = parts(path)
    n = F.size(ps)
    proper = F.when(
        n > 1,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(ps, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))
    if isinstance(include_self, Column):
        return F.when(include_self, F.concat(proper, F.array(_col(path)))).otherwise(proper)
    if include_self:
        return F.concat(proper, F.array(_col(path)))
    return proper


def tree_key(path, is_dir=False) -> Column:
    """Sort key for the depth-first tree order: per level directories first, then the
    case-folded name, then the name. Each component is written as a flag ('0' directory,
    '1' file), the hex of the UTF-8 bytes of ``lower(name)``, a space, the hex of ``name``,
    a space; byte order of the keys is then exactly the tuple order of the components."""
    ps = parts(path)
    n = F.size(ps)
    d = is_dir if isinstance(is_dir, Column) else F.lit(bool(is_dir))

    def comp(c, i):
        flag = F.when((i == n - 1) & ~d, F.lit("1")).otherwise(F.lit("0"))
        return F.concat(flag, F.hex(F.lower(c)), F.lit(" "), F.hex(c), F.lit(" "))

    return F.array_join(F.transform(ps, comp), "")


def duck_tree_key(path_sql: str, is_dir_sql: str = "false") -> str:
    """DuckDB spelling of :func:`tree_key` for the oracles."""
    return (
        f"array_to_string(list_transform(string_split({path_sql}, '/'), lambda c, i: "
        f"CASE WHEN i = len(string_split({path_sql}, '/')) AND NOT ({is_dir_sql}) THEN '1' ELSE '0' END"
        f" || hex(lower(c)) || ' ' || hex(c) || ' '), '')"
    )
