"""Tree visibility and selection sets.

A tree is a ``nodes(path, is_dir)`` table with paths relative to the tree root. Hidden
subtrees are pruned with one flat predicate over the path components instead of a
recursive walk, and every "any descendant" question is answered by exploding ancestor
paths and equi-joining on them (no cross join, no per-directory walk). Selections are
``(path)`` sets; each operator returns a new set.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.functions import paths as P
from corpuspack.functions.patterns import any_glob, can_match_trailing_slash, glob_shape, glob_to_regex


def hidden(path="path", is_dir="is_dir", hide: Sequence[str] = ()):
    """True when the node or any ancestor is a dot entry, has a name matching a hide glob,
    or is a directory whose ``relative_path + '/'`` matches a hide glob. The tree root is
    never tested."""
    p = F.col(path) if isinstance(path, str) else path
    d = F.col(is_dir) if isinstance(is_dir, str) else is_dir
    by_name = F.exists(P.parts(p), lambda c: c.startswith(".") | any_glob(c, hide))
    dir_globs = [g for g in hide if can_match_trailing_slash(g)]  # others never match "dir/"
    if not dir_globs:
        return by_name
    by_dir = F.exists(P.ancestors(p, include_self=d), lambda a: any_glob(F.concat(a, F.lit("/")), dir_globs))
    return by_name | by_dir


def visible_nodes(nodes: DataFrame, hide: Sequence[str] = ()) -> DataFrame:
    return nodes.where(~hidden("path", "is_dir", hide))


def visible_files(files: DataFrame, hide: Sequence[str] = ()) -> DataFrame:
    """Files of a file table that the tree shows (no ``is_dir`` column needed)."""
    return files.where(~hidden(F.col("path"), F.lit(False), hide))


def node_info(visible: DataFrame) -> DataFrame:
    """``(path, is_dir, is_leaf)`` for every visible node in one aggregation: each node
    emits itself and a "has a child" mark for its parent (map-side combine folds the marks
    of a huge directory before the shuffle). A leaf is a file or an empty directory."""
    rows = visible.select(F.explode(F.array(
        F.struct(F.col("path").alias("p"), F.col("is_dir").alias("d"), F.lit(True).alias("n"), F.lit(False).alias("c")),
        F.struct(P.parent_dir("path").alias("p"), F.lit(None).cast("boolean").alias("d"), F.lit(False).alias("n"),
                 F.lit(True).alias("c")),
    )).alias("r")).select("r.*")
    agg = rows.groupBy("p").agg(F.max("n").alias("n"), F.max("d").alias("d"), F.max("c").alias("c"))
    return agg.where("n").select(
        F.col("p").alias("path"), F.col("d").alias("is_dir"), (~F.col("d") | ~F.col("c")).alias("is_leaf")
    )


def empty_dirs(visible: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Visible directories without a visible child."""
    info = node_info(visible) if info is None else info
    return info.where(F.col("is_dir") & F.col("is_leaf")).select("path")


def leaves(visible: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """What a selection can hold: visible files and visible empty directories."""
    info = node_info(visible) if info is None else info
    return info.where("is_leaf").select("path")


def select_glob(visible_file_paths: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Initial selection: files whose relative path matches any glob; none without globs."""
    return visible_file_paths.where(any_glob(F.col("path"), patterns)).select("path")


def select_all(selection: DataFrame, visible_file_paths: DataFrame) -> DataFrame:
    """Add every visible file; earlier entries (e.g. empty directories) stay."""
    return selection.select("path").unionByName(visible_file_paths.select("path")).distinct()


def deselect_all(selection: DataFrame) -> DataFrame:
    return selection.select("path").where(F.lit(False))


def refresh_selection(selection: DataFrame, visible_file_paths: DataFrame) -> DataFrame:
    """After the tree is re-listed only selected files that still exist stay selected."""
    return selection.select("path").join(visible_file_paths.select("path"), "path", "left_semi")


def keep_selected(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Files whose path is selected. A small selection is broadcast by its statistics or by
    adaptive execution, a large one joined by path."""
    return files.join(selection.select("path").distinct(), "path", "left_semi")


def selected_dirs(visible: DataFrame, selection: DataFrame) -> DataFrame:
    """Directories with a selected descendant (or selected themselves): selected visible
    paths exploded into their ancestors, de-duplicated map-side before the shuffle."""
    sel = selection.select("path").join(visible.select("path"), "path", "left_semi")
    return sel.select(F.explode(P.ancestors(F.col("path"), include_self=True)).alias("path")).distinct()


def dir_rollup(visible: DataFrame, selection: DataFrame) -> DataFrame:
    """``(path, any_selected)`` for every visible directory."""
    hits = selected_dirs(visible, selection)
    return visible.where("is_dir").select("path").join(hits.withColumn("hit", F.lit(True)), "path", "left").select(
        "path", F.coalesce(F.col("hit"), F.lit(False)).alias("any_selected")
    )


def toggle_files(selection: DataFrame, file_targets: DataFrame) -> DataFrame:
    """Symmetric difference: a selected target leaves, an unselected one enters."""
    s = selection.select("path").distinct().withColumn("in_s", F.lit(True))
    t = file_targets.select("path").distinct().withColumn("in_t", F.lit(True))
    j = s.join(t, "path", "full")
    return j.where(F.col("in_s").isNull() | F.col("in_t").isNull()).select("path")


def overlapping_targets(dir_targets: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets lying strictly below a directory target (toggles must be disjoint)."""
    below = targets.select(F.col("path").alias("target"), F.explode(P.ancestors(F.col("path"))).alias("path"))
    return below.join(dir_targets.select("path"), "path", "left_semi")


def toggle(selection: DataFrame, targets: DataFrame, visible: DataFrame, check_disjoint: bool = True) -> DataFrame:
    """Toggle several disjoint nodes at once.

    A file target flips. A directory target with any selected descendant loses all its
    files and empty directories; otherwise they are all added (an empty directory toggles
    itself). Targets that are not visible nodes are ignored. Overlapping targets (one inside
    a directory target) make the query fail when it runs.
    """
    from corpuspack.session import materialize

    # what is known of each path, written once: every step below reads it (paths only, no content)
    chosen = selection.select("path").distinct().withColumn("in_s", F.lit(True))
    aimed = targets.select("path").distinct().withColumn("in_t", F.lit(True))
    state = materialize(node_info(visible).join(chosen, "path", "full").join(aimed, "path", "left").select(
        "path", "is_dir", "is_leaf", F.coalesce("in_s", F.lit(False)).alias("in_s"),
        (F.col("in_t") & F.col("is_dir").isNotNull()).alias("in_t")), "node-state")
    shown = state.where("is_dir is not null and (is_leaf or in_s or in_t)")
    below = shown.withColumn("target", F.explode(P.ancestors(F.col("path"), include_self=F.col("is_dir")))).join(
        state.where("in_t and is_dir").select(F.col("path").alias("target")), "target")
    found = below.groupBy("target").agg(
        F.max("in_s").alias("any_selected"), F.coalesce(F.max(F.col("in_t") & (F.col("path") != F.col("target"))), F.lit(False)).alias("overlap"))
    affected = below.where("is_leaf").join(found, "target").select("path", "any_selected")
    rows = state.select("path", "in_s", F.coalesce(F.col("in_t") & ~F.col("is_dir"), F.lit(False)).alias("flips"),
                        F.lit(None).cast("boolean").alias("any_selected"))
    told = rows.unionByName(affected.select("path", F.lit(False).alias("in_s"), F.lit(False).alias("flips"), "any_selected"))
    # below a target the target decides, elsewhere the selection; a file target flips it
    agg = told.groupBy("path").agg(F.max("in_s").alias("in_s"), F.max("flips").alias("flips"), F.max("any_selected").alias("any_selected"))
    on = F.when(F.col("any_selected").isNull(), F.col("in_s")).otherwise(~F.col("any_selected"))
    out = agg.where(on != F.col("flips")).select("path")
    if check_disjoint:
        out = out.unionByName(found.where("overlap").select(
            F.raise_error(F.concat(F.lit("toggle targets overlap: "), F.col("target"))).cast("string").alias("path")))
    return out


def _apply_in_order(regions: pa.Table, toggles: pa.Table) -> pa.Table:
    """Run one component's toggles over its regions; the regions that were set, and to what.

    Targets in tree order have their descendants right behind them, so a target is an interval of
    entry and exit numbers, and a toggle one test and one assignment of an interval.
    """
    order = sorted(zip(toggles.column("seq").to_pylist(), toggles.column("path").to_pylist()))
    names = sorted({p for _, p in order}, key=lambda p: p.split("/"))
    enter, leave, open_ = {n: i for i, n in enumerate(names)}, {}, []
    for n in [*names, None]:
        while open_ and (n is None or not n.startswith(open_[-1] + "/")):
            leave[open_.pop()] = len(names) if n is None else enter[n]
        open_.append(n)
    held, some, fixed = (np.zeros(len(names), bool) for _ in range(3))
    value = np.full(len(names), -1, np.int8)
    for r in regions.to_pylist():
        i = enter[r["region"]]
        held[i], some[i], fixed[i] = r["held"], r["some"], r["fixed"]
    for _, p in order:
        here = slice(enter[p], leave[p])
        on = not (some[here].any() or fixed[here].any())
        some[here] = held[here] & on
        value[here] = on
    told = np.flatnonzero((value >= 0) & held)
    return pa.table({"region": pa.array([names[i] for i in told], pa.string()), "value": pa.array(value[told] > 0)})


def toggle_sequence(selection: DataFrame, toggles: DataFrame, visible: DataFrame) -> DataFrame:
    """Apply ``toggles(seq, path)`` one after the other; targets may repeat and lie inside each other.

    Each toggle follows the rule of :func:`toggle` on the selection as the ones before left it. Leaves with
    the same deepest target always change together, so they are one region: whether any of it is selected
    is counted over all leaves, and only regions and toggles meet in order. Targets that don't share an
    ancestor target are apart; a component has at most as many regions as toggles, however many leaves
    there are. Equal ``seq`` go by path; targets that are no visible nodes are ignored.
    """
    from corpuspack.session import materialize

    chosen = selection.select("path").distinct().withColumn("in_s", F.lit(True))
    state = materialize(node_info(visible).join(chosen, "path", "full").select(
        "path", "is_dir", "is_leaf", F.coalesce("in_s", F.lit(False)).alias("in_s")), "node-state")
    shown = state.where("is_dir is not null")
    asked = materialize(toggles.select("seq", "path").join(shown.select("path"), "path", "left_semi"), "toggles")
    target = asked.select(F.col("path").alias("t")).distinct()

    def inside(rows: DataFrame) -> DataFrame:
        """Each path with its deepest (``region``) and outermost (``part``) target, if it has one."""
        up = rows.select("path", F.explode(P.ancestors(F.col("path"), include_self=True)).alias("t")).join(target, "t")
        return up.groupBy("path").agg(F.max_by("t", F.length("t")).alias("region"), F.min_by("t", F.length("t")).alias("part"))

    placed = materialize(shown.where("is_leaf or in_s").join(inside(shown.where("is_leaf or in_s").select("path")), "path"), "placed")
    regions = placed.groupBy("part", "region").agg(F.max("is_leaf").alias("held"), F.max(F.col("is_leaf") & F.col("in_s")).alias("some"),
                                                  F.max(~F.col("is_leaf") & F.col("in_s")).alias("fixed"))
    parts = inside(target.withColumnRenamed("t", "path")).select("path", F.col("part").alias("of"))
    ordered = asked.join(parts, "path").select("of", F.col("seq"), "path")
    # toggles of a part without any leaf change nothing, and a part has toggles by its nature
    told = ordered.groupBy("of").cogroup(regions.groupBy("part")).applyInArrow(
        lambda t, r: _apply_in_order(r, t), "region string, value boolean")
    decided = placed.where("is_leaf").join(told, "region").select("path", "value")
    rows = state.where("in_s").select("path", F.lit(None).cast("boolean").alias("value")).unionByName(decided)
    return rows.groupBy("path").agg(F.max("value").alias("value")).where(F.coalesce("value", F.lit(True))).select("path")


def selection_count(selection: DataFrame) -> DataFrame:
    return selection.select("path").distinct().agg(F.count(F.lit(1)).alias("n_selected"))


# ---------------------------------------------------------------------------------------
# keyword and glob tables (substring joins without a nested loop)


#: Characters of keywords that one automaton holds (some 50 bytes each), and values that meet it at once.
KEYWORD_CHARS = 2_000_000
VALUES_PER_GROUP = 100_000


def _matcher(first: bool):
    """What the values of a group hold of its keywords, in one pass over each value."""

    def run(values: pa.Table, keywords: pa.Table) -> pa.Table:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        known = keywords.column("keyword").to_pylist()
        for k in known:
            if k:
                automaton.add_word(k, k)
        automaton.make_automaton()
        blank = [""] if "" in known else []  # every value holds the empty keyword
        out_values, out_keywords = [], []
        for v in values.column("value").to_pylist():
            hits = blank if first and blank else ({k for _, k in automaton.iter(v)} if not first else [
                k for _, k in [next(automaton.iter(v), (0, None))] if k is not None]) if len(automaton) else []
            hits = [*hits, *([] if first else blank)]
            out_values += [v] * len(hits)
            out_keywords += hits
        return pa.table({"value": pa.array(out_values, pa.string()), "keyword": pa.array(out_keywords, pa.string())})

    return run


def containing(df: DataFrame, col: str, keywords: DataFrame, kw_col: str, first: bool = False) -> DataFrame:
    """``(value, keyword)`` for each different value of ``col`` and each keyword it contains; with
    ``first`` only the keyword that ends first in it, of each part of the keywords.

    Each value is read once by an automaton of all keywords (Aho-Corasick), so the work doesn't grow with
    the keywords' number or lengths. Keywords are dealt into parts of at most about ``KEYWORD_CHARS``, and
    different values into groups of about ``VALUES_PER_GROUP``; a task has one part and one group. Only
    values are carried, never the rows; NULLs match nothing, the empty keyword matches every value.
    """
    kw = keywords.select(F.col(kw_col).cast("string").alias("keyword")).where("keyword is not null").distinct()
    values = df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    parts = kw.agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.length("keyword")), F.lit(0)) / KEYWORD_CHARS)).cast("int")).scalar()
    groups = df.agg(F.greatest(F.lit(1), F.ceil(F.count(col) / VALUES_PER_GROUP)).cast("int")).scalar()
    dealt = values.select("value", F.pmod(F.xxhash64("value"), groups).cast("int").alias("g")).select(
        "value", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    copied = kw.select("keyword", F.pmod(F.xxhash64("keyword"), parts).cast("int").alias("q")).select(
        "keyword", "q", F.explode(F.sequence(F.lit(0), groups - 1)).alias("h"))
    return dealt.groupBy("p", "g").cogroup(copied.groupBy("q", "h")).applyInArrow(_matcher(first), "value string, keyword string")


def anti_contains(df: DataFrame, keywords: DataFrame, col: str, kw_col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` contains none of the keywords (a NULL ``col`` contains none)."""
    hits = containing(df, col, keywords, kw_col, first=True).select(F.col("value").alias("_hit")).distinct()
    return df.join(hits, F.col(col) == F.col("_hit"), "left_anti")


def semi_contains(df: DataFrame, keywords: DataFrame, col: str, kw_col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` contains a keyword; without any keyword all rows, as an empty
    include list keeps everything."""
    hits = containing(df, col, keywords, kw_col, first=True).select(F.col("value").alias("_hit")).distinct()
    listed = keywords.where(F.col(kw_col).isNotNull()).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    found = df.join(hits.withColumn("_found", F.lit(True)), F.col(col) == F.col("_hit"), "left")
    return found.where(F.col("_found") | ~listed).drop("_hit", "_found")


def glob_candidates(df: DataFrame, globs: DataFrame, col: str = "path", glob_col: str = "glob") -> DataFrame:
    """``(value, glob, pattern)`` of the pairs that :func:`glob_matches` tries.

    Every literal run of a glob must occur in a value it matches, in their order. All runs of all globs are
    looked for in one pass over the values; each glob is filed under the run that the fewest values hold,
    so a common ending doesn't bring a glob to every value that has it. A glob one of whose runs no
    value holds is tried nowhere. Of what is left the length and the fixed beginning and end must fit.
    """
    from corpuspack.session import materialize

    def parsed(batches):
        for batch in batches:
            patterns = batch.column(0).to_pylist()
            shapes = [glob_shape(p) for p in patterns]
            yield pa.RecordBatch.from_pydict({
                "glob": batch.column(0), "pattern": pa.array([glob_to_regex(p) for p in patterns], pa.string()),
                "runs": pa.array([s[0] or [""] for s in shapes], pa.list_(pa.string())), "least": pa.array([s[1] for s in shapes], pa.int32()),
                "head": pa.array([s[2] for s in shapes], pa.string()), "tail": pa.array([s[3] for s in shapes], pa.string())})

    table = globs.select(F.col(glob_col).cast("string").alias("glob")).where("glob is not null").distinct().mapInArrow(
        parsed, "glob string, pattern string, runs array<string>, least int, head string, tail string")
    table = materialize(table, "globs")
    runs = table.select("glob", F.size(F.array_distinct("runs")).alias("n"), F.explode(F.array_distinct("runs")).alias("keyword"))
    met = materialize(containing(df, col, runs, "keyword"), "glob-runs")
    held = met.groupBy("keyword").agg(F.count(F.lit(1)).alias("held"))
    filed = runs.join(held, "keyword").groupBy("glob").agg(
        F.min_by("keyword", F.struct("held", -F.length("keyword"), "keyword")).alias("keyword"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
    filed = filed.where("found = n").select("glob", "keyword").join(table.drop("runs"), "glob")
    fits = (F.length("value") >= F.col("least")) & F.startswith("value", F.col("head")) & F.endswith("value", F.col("tail"))
    return met.join(filed, "keyword").where(fits).select("value", "glob", "pattern")


def glob_matches(df: DataFrame, globs: DataFrame, col: str = "path", glob_col: str = "glob") -> DataFrame:
    """``(value, glob)`` for each different value of ``col`` and each glob of a table it matches."""
    return glob_candidates(df, globs, col, glob_col).where(F.rlike("value", F.col("pattern"))).select("value", "glob")
