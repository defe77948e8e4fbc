"""corpuspack: pack file collections into ordered text bundles with Spark.

Column functions (native expressions) and DataFrame operators; see README.md.
"""

from corpuspack.functions.patterns import (
    glob_match,
    keyword_filter,
    parse_patterns,
    should_ignore,
    should_include,
)
from corpuspack.functions.text import (
    comment_prefix,
    extension,
    read_text,
    remove_docstrings,
    remove_docstrings_lines,
    split_lines,
    strip_comments,
    strip_comments_lines,
    transform_line_array,
    transform_source,
)
from corpuspack.operators.bundle import (
    build_bundles,
    bundle_stats,
    create_bundle,
    file_blocks,
    file_keys,
    pack,
    pack_stats,
    write_bundles,
    written_stats,
)

from corpuspack.operators.selection import (
    anti_contains,
    dir_rollup,
    empty_dirs,
    glob_matches,
    refresh_selection,
    select_all,
    select_glob,
    semi_contains,
    toggle,
    visible_files,
    visible_nodes,
)
from corpuspack.sources.files import list_store
from corpuspack.sources.tree import list_tree, read_listed
from corpuspack.streaming.watch import (
    BundleRebuilder,
    poll_tree,
    snapshot_changes,
    snapshot_diff,
    throttle,
    throttle_stream,
    tree_snapshot,
    watch,
    watch_filter,
)

# names of the original tool's functions, as column functions
get_comment_prefix = comment_prefix
apply_transformations = transform_line_array
strip_single_line_comments = strip_comments_lines
remove_python_docstrings = remove_docstrings_lines

__all__ = [
    "apply_transformations", "build_bundles", "bundle_stats", "comment_prefix", "create_bundle", "extension",
    "file_blocks", "get_comment_prefix", "glob_match", "keyword_filter", "pack", "parse_patterns", "read_text",
    "remove_docstrings", "remove_docstrings_lines", "remove_python_docstrings", "should_ignore", "should_include",
    "split_lines", "strip_comments", "strip_comments_lines", "strip_single_line_comments", "transform_line_array",
    "transform_source", "write_bundles", "written_stats",
    "dir_rollup", "empty_dirs", "refresh_selection", "select_all", "select_glob", "toggle", "visible_files",
    "visible_nodes", "list_tree", "BundleRebuilder", "snapshot_changes", "snapshot_diff", "throttle",
    "throttle_stream", "tree_snapshot", "watch", "watch_filter",
    "anti_contains", "file_keys", "glob_matches", "list_store", "pack_stats", "poll_tree", "read_listed", "semi_contains",
]
