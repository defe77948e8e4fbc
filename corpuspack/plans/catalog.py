"""Registered queries: one per operator of the inventory, each with a DuckDB oracle.

Every query reads the driver tables (through the derived views of ``fixtures``) and runs
over them whole. Parameters (hide globs, keywords, the throttle gap) are fixed here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.functions import paths as P
from corpuspack.functions import patterns as G
from corpuspack.functions import text as T
from corpuspack.functions.times import epoch_micros
from corpuspack.functions.sql import register_sql_functions
from corpuspack.operators import bundle as B
from corpuspack.operators import ordering as O
from corpuspack.operators import selection as S
from corpuspack.operators import transform as TR
from corpuspack.operators.partstore import PartStore
from corpuspack.plans import duck as D
from corpuspack.plans.fixtures import Tables, duck_with
from corpuspack.session import scratch_path
from corpuspack.sources import files as SF
from corpuspack.streaming import watch as W

# query parameters
HIDE = ["__pycache__", "Test_*", "src1[0-3]/fr/"]
SELECT_GLOBS = ["*.py", "src2/*/m1?.c*", "*/[!e]?/*[0-4].rs"]
GLOBS = ["*.py", "src1?/*", "*/[de][!e]/*", "*[0-3][!0-5].[a-c]*", "src[2-5]/*/m*[]7].?s", "*[z-a]*", "*[!]*", "*[*"]
IGNORE_NAMES = ["Test_", "__init"]
IGNORE_PATHS = ["/tests/", "/.cache/"]
INCLUDE_NAMES = ["1", "7"]
GAP_SECONDS = 2 * 3600.0

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def _with(sql: str, views: list[str], ctes: list[tuple[str, str]], recursive: bool = False) -> str:
    """Oracle text: derived views + extra CTEs + final query."""
    parts = []
    if views:
        base = duck_with("SELECT 1", *views)
        parts.append(base[len("WITH "): base.rfind("\nSELECT 1")])
    parts += [f"{n} AS (\n{body.strip()}\n)" for n, body in ctes]
    if not parts:
        return sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + sql.strip()


def _visible_files(t: Tables) -> DataFrame:
    return S.visible_files(t.files, HIDE)


_VIS_FILES_SQL = f"SELECT * FROM files WHERE NOT {D.hidden('path', 'false', HIDE)}"
_VIS_NODES_SQL = f"SELECT * FROM nodes WHERE NOT {D.hidden('path', 'is_dir', HIDE)}"
_EMPTY_SQL = f"""SELECT v.path FROM vis v WHERE v.is_dir AND NOT EXISTS (
  SELECT 1 FROM vis c WHERE {D.parent('c.path')} = v.path)"""

# ---------------------------------------------------------------------------------------
# flagship: visible files -> both transforms -> blocks -> bundle statistics


def flagship(t: Tables) -> DataFrame:
    return B.pack_stats(_visible_files(t), remove_comments=True, remove_docstrings=True)


_STATS_SQL = f"""SELECT bundle,
  CAST(count(*) FILTER (WHERE is_file) AS BIGINT) AS n_files,
  CAST(sum({D.newlines('block')}) + 1 AS BIGINT) AS n_lines,
  CAST(sum(length(block)) AS BIGINT) AS n_chars,
  round_even(CAST(sum(length(block)) AS DOUBLE) / 1024.0, 1) AS kb
FROM blocks GROUP BY bundle"""

_FLAGSHIP_SQL = _with(_STATS_SQL, ["files"], [("vis", _VIS_FILES_SQL), ("blocks", D.blocks_cte("vis", True, True))])


@query("bundle_stats", _FLAGSHIP_SQL)
def q_bundle_stats(spark, sf):
    return flagship(Tables(spark, sf))


# ---------------------------------------------------------------------------------------
# sources


@query("decode_text", _with(
    f"""SELECT doc_id, path, doc_id % 37 <> 0 AS ok,
      CASE WHEN doc_id % 37 <> 0 THEN md5(content) END AS text_md5,
      CASE WHEN doc_id % 37 <> 0 THEN CAST(length(content) AS BIGINT) END AS n_chars
    FROM files""", ["files"], []))
def q_decode_text(spark, sf):
    dec = SF.decode_files(Tables(spark, sf).raw_files)
    return dec.select(
        "doc_id", "path", F.col("text").isNotNull().alias("ok"), F.md5("text").alias("text_md5"),
        T.char_count("text").alias("n_chars"),
    )


@query("rejects", _with(
    "SELECT bundle, path, 'not valid UTF-8' AS reason FROM files WHERE doc_id % 37 = 0", ["files"], []))
def q_rejects(spark, sf):
    return SF.rejects_undecodable(SF.decode_files(Tables(spark, sf).raw_files))


@query("parse_patterns", f"""
SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_patterns, md5(array_to_string(p, chr(31))) AS patterns_md5
FROM (SELECT conv_id, turn, {D.parse_patterns('text')} AS p FROM conversations)""")
def q_parse_patterns(spark, sf):
    conv = Tables(spark, sf).table("conversations")
    p = G.parse_patterns_col(F.col("text"))
    return conv.select(
        "conv_id", "turn", F.size(p).cast("bigint").alias("n_patterns"),
        F.md5(F.array_join(p, "\u001f")).alias("patterns_md5"),
    )


@query("write_bundle", _with(
    """SELECT bundle, CAST(sum(length(block) - length(replace(block, chr(10), ''))) + 1 AS BIGINT) AS n_lines,
         CAST(sum(length(block)) AS BIGINT) AS n_chars,
         round_even(CAST(sum(length(block)) AS DOUBLE) / 1024.0, 1) AS kb
       FROM blocks GROUP BY bundle""",
    ["files"], [("vis", _VIS_FILES_SQL), ("blocks", D.blocks_cte("vis", True, True))]))
def q_write_bundle(spark, sf):
    t = Tables(spark, sf)
    vis = _visible_files(t)
    out = scratch_path(spark, "bundles")
    B.write_bundles(B.pack(vis, remove_comments=True, remove_docstrings=True), out, keys=B.file_keys(vis))
    return B.written_stats(spark, out)


_WRITTEN_SQL = """SELECT bundle, CAST(sum(length(block) - length(replace(block, chr(10), ''))) + 1 AS BIGINT) AS n_lines,
         CAST(sum(length(block)) AS BIGINT) AS n_chars,
         round_even(CAST(sum(length(block)) AS DOUBLE) / 1024.0, 1) AS kb
       FROM blocks GROUP BY bundle"""


@query("pack_empty", _with(_WRITTEN_SQL, ["files"], [("vis", _VIS_FILES_SQL), ("blocks", D.blocks_cte("vis"))]))
def q_pack_empty(spark, sf):
    """An empty selection writes nothing: the bundles written before stay as they are."""
    vis = _visible_files(Tables(spark, sf))
    out = scratch_path(spark, "bundles")
    B.write_bundles(B.pack(vis), out, keys=B.file_keys(vis))
    if B.build_bundles(vis, S.select_glob(vis, []), out, remove_comments=True) is not None:
        raise AssertionError("an empty selection was written")
    return B.written_stats(spark, out)


@query("bundle_names", _with(_WRITTEN_SQL, ["files"], [
    ("named", """SELECT CASE WHEN doc_id % 2 = 0 THEN lpad(CAST(doc_id % 5 AS VARCHAR), 3, '0') ELSE CAST(doc_id % 5 AS VARCHAR) END
         AS bundle, path, content FROM files"""), ("blocks", D.blocks_cte("named"))]))
def q_bundle_names(spark, sf):
    """Names that look like numbers stay what they are when bundles are read back."""
    digit = (F.col("doc_id") % 5).cast("string")
    named = Tables(spark, sf).files.withColumn("bundle", F.when(F.col("doc_id") % 2 == 0, F.lpad(digit, 3, "0")).otherwise(digit))
    out = scratch_path(spark, "bundles")
    B.write_bundles(B.pack(named), out, keys=B.file_keys(named))
    return B.written_stats(spark, out)


# ---------------------------------------------------------------------------------------
# projections


@query("path_parts", _with(
    f"""SELECT path, {D.rel()} AS rel, {D.name()} AS name, {D.parent()} AS parent, {D.ext()} AS ext,
      CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM files""", ["files"], []))
def q_path_parts(spark, sf):
    f = Tables(spark, sf).files
    p = F.col("path")
    return f.select(
        "path", P.relative_to(p, F.col("bundle")).alias("rel"), P.base_name(p).alias("name"),
        P.parent_dir(p).alias("parent"), T.extension(P.base_name(p)).alias("ext"), P.depth(p).alias("depth"),
    )


@query("normalize_separators", _with("SELECT doc_id, path AS normalized FROM files", ["files"], []))
def q_normalize_separators(spark, sf):
    """Paths written with backslashes, every other separator or all, become what they were."""
    f = Tables(spark, sf).files
    every = F.replace("path", F.lit("/"), F.lit("\\"))
    first = F.regexp_replace("path", "^([^/]*)/", "$1\\\\")
    written = F.when(F.col("doc_id") % 2 == 0, every).otherwise(first)
    return f.select("doc_id", P.normalize_separators(written).alias("normalized"))


@query("comment_prefix", _with(
    f"SELECT path, {D.ext()} AS ext, {D.comment_prefix(D.ext())} AS prefix FROM files", ["files"], []))
def q_comment_prefix(spark, sf):
    f = Tables(spark, sf).files
    e = T.extension(P.base_name(F.col("path")))
    return f.select("path", e.alias("ext"), T.comment_prefix(e).alias("prefix"))


@query("explode_lines", _with(
    """SELECT path, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS line
       FROM (SELECT path, regexp_extract_all(content, '([^\\n]*\\n|[^\\n]+)', 1) AS l FROM files)""", ["files"], []))
def q_explode_lines(spark, sf):
    f = Tables(spark, sf).files
    return f.select("path", F.posexplode(T.split_lines("content")).alias("pos", "line")).select(
        "path", F.col("pos").cast("bigint").alias("pos"), "line"
    )


@query("file_blocks", _with(
    f"""SELECT bundle, path, CAST(length(block) AS BIGINT) AS n_chars, md5(block) AS block_md5
       FROM ({D.blocks_cte('files')}) b WHERE is_file""", ["files"], []))
def q_file_blocks(spark, sf):
    blocks = B.file_blocks(Tables(spark, sf).files)
    return blocks.select("bundle", "path", T.char_count("block").alias("n_chars"), F.md5("block").alias("block_md5"))


@query("nodes", _with(
    f"""SELECT path, is_dir, {D.parent()} AS parent, {D.name()} AS name,
      CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM nodes""", ["nodes"], []))
def q_nodes(spark, sf):
    n = Tables(spark, sf).nodes
    p = F.col("path")
    return n.select("path", "is_dir", P.parent_dir(p).alias("parent"), P.base_name(p).alias("name"),
                    P.depth(p).alias("depth"))


# ---------------------------------------------------------------------------------------
# filters


@query("include_names", _with(
    f"SELECT bundle, path FROM files WHERE {D.contains_any(D.name(), INCLUDE_NAMES)}", ["files"], []))
def q_include_names(spark, sf):
    f = Tables(spark, sf).files
    return f.where(G.should_include(P.base_name(F.col("path")), INCLUDE_NAMES)).select("bundle", "path")


@query("ignore_names", _with(
    f"SELECT bundle, path FROM files WHERE NOT {D.contains_any(D.name(), IGNORE_NAMES)}", ["files"], []))
def q_ignore_names(spark, sf):
    f = Tables(spark, sf).files
    return f.where(~G.should_ignore(P.base_name(F.col("path")), F.col("path"), IGNORE_NAMES, [])).select(
        "bundle", "path")


@query("ignore_paths", _with(
    f"SELECT bundle, path FROM files WHERE NOT {D.contains_any('path', IGNORE_PATHS)}", ["files"], []))
def q_ignore_paths(spark, sf):
    f = Tables(spark, sf).files
    return f.where(~G.should_ignore(P.base_name(F.col("path")), F.col("path"), [], IGNORE_PATHS)).select(
        "bundle", "path")


@query("keyword_filter", _with(
    f"""SELECT bundle, path FROM files WHERE NOT ({D.contains_any(D.name(), IGNORE_NAMES)}
        OR {D.contains_any('path', IGNORE_PATHS)}) AND {D.contains_any(D.name(), INCLUDE_NAMES)}""",
    ["files"], []))
def q_keyword_filter(spark, sf):
    f = Tables(spark, sf).files
    pred = G.keyword_filter(P.base_name(F.col("path")), F.col("path"), IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    return f.where(pred).select("bundle", "path")


@query("glob_match", _with(
    "SELECT path, " + ", ".join(f"{D.any_glob('path', [g])} AS g{i}" for i, g in enumerate(GLOBS)) + " FROM files",
    ["files"], []))
def q_glob_match(spark, sf):
    f = Tables(spark, sf).files
    return f.select("path", *[G.glob_match(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(GLOBS)])


@query("visible", _with(
    f"SELECT path, is_dir FROM nodes WHERE NOT {D.hidden('path', 'is_dir', HIDE)}", ["nodes"], []))
def q_visible(spark, sf):
    return S.visible_nodes(Tables(spark, sf).nodes, HIDE).select("path", "is_dir")


@query("select_glob", _with(
    f"SELECT path FROM vis WHERE {D.any_glob('path', SELECT_GLOBS)}", ["files"], [("vis", _VIS_FILES_SQL)]))
def q_select_glob(spark, sf):
    return S.select_glob(_visible_files(Tables(spark, sf)), SELECT_GLOBS)


@query("select_semi", _with(
    "SELECT bundle, path FROM files WHERE path IN (SELECT path FROM selection)", ["files", "selection"], []))
def q_select_semi(spark, sf):
    t = Tables(spark, sf)
    return S.keep_selected(t.files, t.selection).select("bundle", "path")


# ---------------------------------------------------------------------------------------
# transforms


@query("strip_comments", _with(
    f"""SELECT path, ext, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars
       FROM (SELECT path, ext, {D.strip_comments('content', 'ext')} AS t
             FROM (SELECT *, {D.ext()} AS ext FROM files))""", ["files"], []))
def q_strip_comments(spark, sf):
    f = Tables(spark, sf).files.withColumn("ext", T.extension(P.base_name(F.col("path"))))
    t = T.strip_comments(F.col("content"), F.col("ext"))
    return f.select("path", "ext", F.md5(t).alias("text_md5"), T.char_count(t).alias("n_chars"))


@query("remove_docstrings", _with(
    f"""SELECT path, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars
       FROM (SELECT path, {D.remove_docstrings('content')} AS t FROM files)""", ["files"], []))
def q_remove_docstrings(spark, sf):
    f = Tables(spark, sf).files
    t = T.remove_docstrings(F.col("content"))
    return f.select("path", F.md5(t).alias("text_md5"), T.char_count(t).alias("n_chars"))


@query("transform_all", _with(
    f"""SELECT path, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars
       FROM (SELECT path, {D.transform('content', 'ext', True, True)} AS t
             FROM (SELECT *, {D.ext()} AS ext FROM files))""", ["files"], []))
def q_transform_all(spark, sf):
    f = Tables(spark, sf).files.withColumn("ext", T.extension(P.base_name(F.col("path"))))
    t = T.transform_source(F.col("content"), F.col("ext"), True, True)
    return f.select("path", F.md5(t).alias("text_md5"), T.char_count(t).alias("n_chars"))


_LINES_RE_SQL = D.sq(T.LINES_RE)


@query("transform_lines", _with(
    f"""SELECT path, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS line
       FROM (SELECT path, regexp_extract_all({D.transform('text', 'ext', True, True)}, {_LINES_RE_SQL}, 1) AS l
             FROM (SELECT path, {D.ext()} AS ext, string_agg(line, '' ORDER BY pos) AS text FROM (
                   SELECT path, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
                   FROM (SELECT path, regexp_extract_all(content, {_LINES_RE_SQL}, 1) AS l FROM files))
                   GROUP BY path))""", ["files"], []))
def q_transform_lines(spark, sf):
    lines = TR.explode_lines(Tables(spark, sf).files)
    return TR.transform_lines(lines, remove_comments=True, remove_docstrings=True)


# ---------------------------------------------------------------------------------------
# aggregations


@query("pack_bundle", _with(
    f"""SELECT bundle, CAST(row_number() OVER (PARTITION BY bundle ORDER BY okey) - 1 AS BIGINT) AS seq,
         CAST(coalesce(sum(length(block)) OVER (PARTITION BY bundle ORDER BY okey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         path, is_file, CAST(length(block) AS BIGINT) AS n_chars, md5(block) AS block_md5
       FROM blocks""",
    ["files"], [("vis", _VIS_FILES_SQL), ("blocks", D.blocks_cte("vis", True, True))]))
def q_pack_bundle(spark, sf):
    t = Tables(spark, sf)
    blocks = B.pack(_visible_files(t), remove_comments=True, remove_docstrings=True)
    sized = blocks.select("bundle", "okey", "path", "is_file", T.char_count("block").alias("n_chars"),
                          F.md5("block").alias("block_md5"))
    placed = O.positions(sized, "bundle", "okey", size="n_chars")
    return placed.select("bundle", "seq", "offset", "path", "is_file", "n_chars", "block_md5")


@query("processed_count", _with(
    "SELECT bundle, count(*) AS n_processed FROM files WHERE doc_id % 37 <> 0 GROUP BY bundle", ["files"], []))
def q_processed_count(spark, sf):
    dec = SF.decode_files(Tables(spark, sf).raw_files)
    return B.processed_count(B.file_blocks(dec, text_col="text"))


@query("selection_count", _with(
    "SELECT count(DISTINCT path) AS n_selected FROM selection", ["selection"], []))
def q_selection_count(spark, sf):
    return S.selection_count(Tables(spark, sf).selection)


@query("dir_rollup", _with(
    """SELECT d.path, EXISTS (SELECT 1 FROM sv WHERE sv.path = d.path OR starts_with(sv.path, d.path || '/'))
         AS any_selected FROM vis d WHERE d.is_dir""",
    ["nodes", "selection"], [("vis", _VIS_NODES_SQL),
                             ("sv", "SELECT path FROM selection WHERE path IN (SELECT path FROM vis)")]))
def q_dir_rollup(spark, sf):
    t = Tables(spark, sf)
    return S.dir_rollup(S.visible_nodes(t.nodes, HIDE), t.selection)


@query("empty_dirs", _with(_EMPTY_SQL, ["nodes"], [("vis", _VIS_NODES_SQL)]))
def q_empty_dirs(spark, sf):
    return S.empty_dirs(S.visible_nodes(Tables(spark, sf).nodes, HIDE))


# ---------------------------------------------------------------------------------------
# orders


@query("tree_order", _with(
    f"""SELECT path, is_dir, {D.tree_key('path', 'is_dir')} AS okey,
         CAST(row_number() OVER (ORDER BY {D.tree_key('path', 'is_dir')}) - 1 AS BIGINT) AS seq
       FROM vis""", ["nodes"], [("vis", _VIS_NODES_SQL)]))
def q_tree_order(spark, sf):
    vis = S.visible_nodes(Tables(spark, sf).nodes, HIDE).select("path", "is_dir")
    keyed = O.tree_order(vis).withColumn("tree", F.lit(""))
    return O.positions(keyed, "tree", "okey").select("path", "is_dir", "okey", "seq")


@query("sibling_rank", _with(
    f"""SELECT path, {D.parent()} AS parent, {D.name()} AS name, is_dir,
         CAST(row_number() OVER (PARTITION BY {D.parent()} ORDER BY
           CASE WHEN is_dir THEN '0' ELSE '1' END || hex(lower({D.name()})) || ' ' || hex({D.name()})) AS BIGINT)
           AS sibling_rank
       FROM vis""", ["nodes"], [("vis", _VIS_NODES_SQL)]))
def q_sibling_rank(spark, sf):
    return O.sibling_rank(S.visible_nodes(Tables(spark, sf).nodes, HIDE))


_EXPLICIT_SQL = """
SELECT 'list' AS bundle, l.doc_id * 4 + 1 AS seq, f.path FROM labels l JOIN files f USING (doc_id)
UNION ALL
SELECT 'list', l.doc_id * 4 + 2, f.path FROM labels l JOIN files f USING (doc_id) WHERE l.toxic = 1
UNION ALL
SELECT 'list', l.doc_id * 4 + 3, regexp_extract(f.path, '(?s)\\A(.*)/', 1) FROM labels l JOIN files f USING (doc_id)
WHERE l.quality = 0
"""


def _explicit_paths(t: Tables) -> DataFrame:
    lab = t.table("labels")
    f = t.files.select("doc_id", "path")
    j = lab.join(f, "doc_id")
    a = j.select(F.lit("list").alias("bundle"), (F.col("doc_id") * 4 + 1).alias("seq"), "path")
    b = j.where("toxic = 1").select(F.lit("list").alias("bundle"), (F.col("doc_id") * 4 + 2).alias("seq"), "path")
    c = j.where("quality = 0").select(F.lit("list").alias("bundle"), (F.col("doc_id") * 4 + 3).alias("seq"),
                                      P.parent_dir(F.col("path")).alias("path"))
    return a.unionByName(b).unionByName(c)


@query("pack_explicit_list", _with(
    f"""SELECT e.seq, e.path, md5('# ==== BEGIN FILE: ' || e.path || ' ====' || chr(10) || f.content || chr(10)
          || '# ==== END FILE: ' || e.path || ' ====' || chr(10) || chr(10)) AS block_md5
       FROM explicit e JOIN files f ON f.path = e.path""",
    ["files"], [("explicit", _EXPLICIT_SQL)]))
def q_pack_explicit_list(spark, sf):
    t = Tables(spark, sf)
    found, _ = SF.explicit_list(t.files.drop("bundle"), _explicit_paths(t), t.nodes.where("is_dir"))
    blocks = B.file_blocks(found.withColumn("okey", SF.seq_key()), root=F.lit(""), order="okey")
    # the order key is the zero-padded list position
    return blocks.select(F.col("okey").cast("bigint").alias("seq"), "path", F.md5("block").alias("block_md5"))


@query("list_rejects", _with(
    """SELECT e.seq, e.path, CASE WHEN e.path IN (SELECT path FROM nodes WHERE is_dir) THEN 'is a directory'
         ELSE 'not found' END AS reason
       FROM explicit e WHERE e.path NOT IN (SELECT path FROM files)""",
    ["files", "nodes"], [("explicit", _EXPLICIT_SQL)]))
def q_list_rejects(spark, sf):
    t = Tables(spark, sf)
    _, rej = SF.explicit_list(t.files.drop("bundle"), _explicit_paths(t), t.nodes.where("is_dir"))
    return rej.select("seq", "path", "reason")


# ---------------------------------------------------------------------------------------
# selection sets


@query("select_all", _with(
    "SELECT path FROM selection UNION SELECT path FROM vis", ["files", "selection"], [("vis", _VIS_FILES_SQL)]))
def q_select_all(spark, sf):
    t = Tables(spark, sf)
    return S.select_all(t.selection, _visible_files(t))


@query("deselect_all", _with("SELECT path FROM selection WHERE false", ["selection"], []))
def q_deselect_all(spark, sf):
    return S.deselect_all(Tables(spark, sf).selection)


@query("refresh_selection", _with(
    "SELECT path FROM selection WHERE path IN (SELECT path FROM vis)", ["files", "selection"],
    [("vis", _VIS_FILES_SQL)]))
def q_refresh_selection(spark, sf):
    t = Tables(spark, sf)
    return S.refresh_selection(t.selection, _visible_files(t))


_TOGGLE_CTES = [
    ("vis", _VIS_NODES_SQL),
    ("emp", _EMPTY_SQL),
    ("lv", "SELECT path FROM vis WHERE NOT is_dir UNION ALL SELECT path FROM emp"),
    ("tv", "SELECT DISTINCT t.path, v.is_dir FROM toggle_targets t JOIN vis v USING (path)"),
    ("sv", "SELECT DISTINCT path FROM selection WHERE path IN (SELECT path FROM vis)"),
    ("flags", """SELECT tv.path AS target, EXISTS (SELECT 1 FROM sv WHERE sv.path = tv.path
                 OR starts_with(sv.path, tv.path || '/')) AS any_selected FROM tv WHERE tv.is_dir"""),
    ("aff", """SELECT lv.path, flags.any_selected FROM lv JOIN flags
               ON lv.path = flags.target OR starts_with(lv.path, flags.target || '/')"""),
    ("s1", """SELECT DISTINCT path FROM (
               SELECT path FROM selection WHERE path NOT IN (SELECT path FROM aff WHERE any_selected)
               UNION ALL SELECT path FROM aff WHERE NOT any_selected)"""),
    ("ft", "SELECT path FROM tv WHERE NOT is_dir"),
]


@query("toggle_dirs", _with(
    """SELECT path FROM s1 WHERE path NOT IN (SELECT path FROM ft)
       UNION ALL SELECT path FROM ft WHERE path NOT IN (SELECT path FROM s1)""",
    ["nodes", "selection", "toggle_targets"], _TOGGLE_CTES))
def q_toggle_dirs(spark, sf):
    t = Tables(spark, sf)
    return S.toggle(t.selection, t.toggle_targets, S.visible_nodes(t.nodes, HIDE))


@query("toggle_files", _with(
    """SELECT path FROM (SELECT DISTINCT path FROM selection) s WHERE path NOT IN (SELECT path FROM ft)
       UNION ALL SELECT path FROM ft WHERE path NOT IN (SELECT path FROM selection)""",
    ["files", "selection", "toggle_targets"],
    [("ft", "SELECT DISTINCT path FROM toggle_targets WHERE path IN (SELECT path FROM files)")]))
def q_toggle_files(spark, sf):
    t = Tables(spark, sf)
    ft = t.toggle_targets.join(t.files.select("path"), "path", "left_semi")
    return S.toggle_files(t.selection, ft)


@query("toggle_empty_dir", _with(
    """SELECT path FROM (SELECT DISTINCT path FROM selection) s WHERE path NOT IN (SELECT path FROM emp)
       UNION ALL SELECT path FROM emp WHERE path NOT IN (SELECT path FROM selection)""",
    ["nodes", "selection"], [("vis", _VIS_NODES_SQL), ("emp", _EMPTY_SQL)]))
def q_toggle_empty_dir(spark, sf):
    t = Tables(spark, sf)
    vis = S.visible_nodes(t.nodes, HIDE)
    return S.toggle(t.selection, S.empty_dirs(vis), vis)


@query("snapshot_diff", _with(
    """SELECT coalesce(a.path, b.path) AS path,
         CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS kind
       FROM snapshot_a a FULL OUTER JOIN snapshot_b b ON a.path = b.path
       WHERE a.path IS NULL OR b.path IS NULL OR a.content_hash <> b.content_hash""",
    ["snapshot_a", "snapshot_b"], []))
def q_snapshot_diff(spark, sf):
    t = Tables(spark, sf)
    return W.snapshot_diff(t.snapshot_a, t.snapshot_b)


# ---------------------------------------------------------------------------------------
# joins


@query("watch_selected", _with(
    f"""SELECT event_id, path FROM change_events
       WHERE NOT is_directory AND path IN (SELECT path FROM selection)""", ["change_events", "selection"], []))
def q_watch_selected(spark, sf):
    t = Tables(spark, sf)
    ev = W.watch_filter(t.change_events)
    return ev.join(t.selection.select("path"), "path", "left_semi").select("event_id", "path")


@query("ignore_paths_join", _with(
    """SELECT bundle, path FROM files f WHERE NOT EXISTS (
         SELECT 1 FROM (SELECT DISTINCT '/' || lang || '/' AS kw FROM documents WHERE lang IN ('de', 'fr')) k
         WHERE contains(f.path, k.kw))""", ["files"], []))
def q_ignore_paths_join(spark, sf):
    t = Tables(spark, sf)
    kws = t.table("documents").where(F.col("lang").isin("de", "fr")).select(
        F.concat(F.lit("/"), "lang", F.lit("/")).alias("kw")).distinct()
    return S.anti_contains(t.files, kws, "path", "kw").select("bundle", "path")


@query("include_names_join", _with(
    """SELECT bundle, path FROM files f WHERE EXISTS (
         SELECT 1 FROM (SELECT DISTINCT '/' || lang || '/m' AS kw FROM documents WHERE lang IN ('de', 'fr')) k
         WHERE contains(f.path, k.kw))""", ["files"], []))
def q_include_names_join(spark, sf):
    t = Tables(spark, sf)
    kws = t.table("documents").where(F.col("lang").isin("de", "fr")).select(
        F.concat(F.lit("/"), "lang", F.lit("/m")).alias("kw"))
    return S.semi_contains(t.files, kws, "path", "kw").select("bundle", "path")


@query("glob_table", _with(
    """SELECT DISTINCT f.path AS value, g.glob FROM files f JOIN (
         SELECT DISTINCT source || '/' || lang || '/*[13579].?[!s]*' AS glob FROM documents
         UNION SELECT '*/__init__*' UNION SELECT '?rc[2-4]/*') g ON f.path GLOB g.glob""", ["files"], []))
def q_glob_table(spark, sf):
    t = Tables(spark, sf)
    globs = t.table("documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/*[13579].?[!s]*")).alias("glob"))
    globs = globs.unionByName(spark.createDataFrame([("*/__init__*",), ("?rc[2-4]/*",)], "glob string"))
    return S.glob_matches(t.files, globs)


# ---------------------------------------------------------------------------------------
# change feed


_WATCH_FILTER_SQL = f"""SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t_us, root, path, kind FROM change_events
  WHERE NOT is_directory AND NOT ({D.contains_any(D.name(), IGNORE_NAMES)} OR {D.contains_any('path', IGNORE_PATHS)})
  AND {D.contains_any(D.name(), INCLUDE_NAMES)}"""


@query("ext_filter", _with(
    "SELECT event_id, path FROM change_events WHERE NOT is_directory AND ends_with(path, '.py')",
    ["change_events"], []))
def q_ext_filter(spark, sf):
    return W.watch_filter(Tables(spark, sf).change_events, extension=".py").select("event_id", "path")


@query("watch_filter", _with(_WATCH_FILTER_SQL, ["change_events"], []))
def q_watch_filter(spark, sf):
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    return ev.select("event_id", _t_us(ev, "ts"), "root", "path", "kind")


def _t_us(df: DataFrame, c: str):
    return epoch_micros(df, c).alias("t_us")


_GAP_US = int(GAP_SECONDS * 1_000_000)
_THROTTLE_CTES = [
    ("wf", _WATCH_FILTER_SQL),
    ("ev", "SELECT *, t_us AS t FROM wf"),
    ("nx", f"""SELECT event_id, nid FROM (
                 SELECT tag, event_id, first_value(CASE WHEN tag = 1 THEN event_id END IGNORE NULLS) OVER (
                   PARTITION BY root ORDER BY time, tag, event_id
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nid
                 FROM (SELECT root, t + {_GAP_US} AS time, 0 AS tag, event_id FROM ev
                       UNION ALL SELECT root, t AS time, 1 AS tag, event_id FROM ev))
               WHERE tag = 0"""),
    ("chain", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY root ORDER BY t, event_id) AS rn
                 FROM ev) WHERE rn = 1
               UNION ALL
               SELECT nx.nid FROM chain JOIN nx ON nx.event_id = chain.event_id WHERE nx.nid IS NOT NULL"""),
]


@query("throttle", _with(
    "SELECT event_id, t_us, root, path, kind FROM ev WHERE event_id IN (SELECT event_id FROM chain)",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_throttle(spark, sf):
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    ev = ev.select("event_id", "ts", "root", "path", "kind")
    kept = W.throttle(ev, GAP_SECONDS)
    return kept.select("event_id", _t_us(kept, "ts"), "root", "path", "kind")


@query("throttle_split", _with(
    "SELECT event_id, t_us, root, path, kind FROM ev WHERE event_id IN (SELECT event_id FROM chain)",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_throttle_split(spark, sf):
    """The throttle through its parallel form (every root treated as hot)."""
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    ev = ev.select("event_id", "ts", "root", "path", "kind")
    kept = W.throttle(ev, GAP_SECONDS, method="jump")
    return kept.select("event_id", _t_us(kept, "ts"), "root", "path", "kind")


@query("last_changed", _with(
    """SELECT root, arg_max(path, t) AS last_path, max(t) AS last_us, count(*) AS n_kept
       FROM ev WHERE event_id IN (SELECT event_id FROM chain) GROUP BY root""",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_last_changed(spark, sf):
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    kept = W.throttle(ev.select("event_id", "ts", "root", "path", "kind"), GAP_SECONDS)
    out = W.last_changed(kept)
    return out.select("root", "last_path", _t_us(out, "last_ts").alias("last_us"), "n_kept")


# ---------------------------------------------------------------------------------------
# SQL functions


@query("sql_scalar", _with(
    f"SELECT path, {D.ext()} AS ext, {D.comment_prefix(D.ext())} AS prefix FROM files", ["files"], []))
def q_sql_scalar(spark, sf):
    register_sql_functions(spark)
    files = Tables(spark, sf).files
    return spark.sql(
        "SELECT path, file_ext(substring_index(path, '/', -1)) AS ext, "
        "comment_prefix(file_ext(substring_index(path, '/', -1))) AS prefix FROM {f}", f=files)


@query("sql_transform", _with(
    f"""SELECT path, md5({D.strip_comments('content', 'ext')}) AS stripped_md5,
         md5({D.remove_docstrings('content')}) AS nodoc_md5,
         md5({D.transform('content', 'ext', True, True)}) AS both_md5
       FROM (SELECT *, {D.ext()} AS ext FROM files)""", ["files"], []))
def q_sql_transform(spark, sf):
    register_sql_functions(spark)
    files = Tables(spark, sf).files
    return spark.sql(
        """SELECT path, md5(strip_comments(content, ext)) AS stripped_md5,
             md5(remove_docstrings(content)) AS nodoc_md5,
             md5(transform_source(content, ext, true, true)) AS both_md5
           FROM (SELECT *, file_ext(substring_index(path, '/', -1)) AS ext FROM {f})""", f=files)


# ---------------------------------------------------------------------------------------
# streams (run to completion over a replay of the change feed)


@query("throttle_stream", _with(
    "SELECT event_id, t_us, root, path, kind FROM ev WHERE event_id IN (SELECT event_id FROM chain)",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_throttle_stream(spark, sf):
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    folder = scratch_path(spark, "throttle-stream")
    src = W.replay_source(ev.select("event_id", "ts", "root", "path", "kind"), f"{folder}/in")
    kept = W.run_to_table(W.throttle_stream(src, GAP_SECONDS), folder)
    return kept.select("event_id", _t_us(kept, "ts"), "root", "path", "kind")


_REBUILD_CTES = _THROTTLE_CTES + [
    ("hit", """SELECT DISTINCT f.bundle FROM ev JOIN files f ON f.path = ev.path
               WHERE ev.event_id IN (SELECT event_id FROM chain) AND ev.path IN (SELECT path FROM selection)"""),
    ("chosen", f"""SELECT * FROM files WHERE path IN (SELECT path FROM selection)
                   AND NOT {D.hidden('path', 'false', [])} AND bundle IN (SELECT bundle FROM hit)"""),
    ("blocks", D.blocks_cte("chosen", True, True)),
]


@query("watch_rebuild", _with(
    """SELECT bundle, CAST(sum(length(block) - length(replace(block, chr(10), ''))) + 1 AS BIGINT) AS n_lines,
         CAST(sum(length(block)) AS BIGINT) AS n_chars,
         round_even(CAST(sum(length(block)) AS DOUBLE) / 1024.0, 1) AS kb
       FROM blocks GROUP BY bundle""",
    ["change_events", "selection"], _REBUILD_CTES, recursive=True))
def q_watch_rebuild(spark, sf):
    t = Tables(spark, sf)
    folder = scratch_path(spark, "watch-rebuild")
    out = f"{folder}/bundles"
    rebuild = W.BundleRebuilder(lambda: t.files, t.selection, out, f"{folder}/state",
                                remove_comments=True, remove_docstrings=True)
    src = W.replay_source(t.change_events, f"{folder}/in")
    q = W.watch(src, rebuild, ignore_names=IGNORE_NAMES, ignore_paths=IGNORE_PATHS, include_names=INCLUDE_NAMES,
                gap_seconds=GAP_SECONDS, checkpoint=f"{folder}/checkpoint", trigger={"availableNow": True})
    q.awaitTermination()
    return B.written_stats(spark, out)


@query("watch_initial", _with(_WRITTEN_SQL, ["selection"], [
    ("chosen", f"""SELECT * FROM files WHERE path IN (SELECT path FROM selection) AND NOT {D.hidden('path', 'false', HIDE)}"""),
    ("blocks", D.blocks_cte("chosen", True, True))]))
def q_watch_initial(spark, sf):
    """A watch that starts without asking builds every bundle of its selection first."""
    t = Tables(spark, sf)
    folder = scratch_path(spark, "watch-initial")
    rebuild = W.BundleRebuilder(lambda: t.files, t.selection, f"{folder}/bundles", f"{folder}/state", hide=HIDE,
                                remove_comments=True, remove_docstrings=True)
    rebuild.build_all(spark)
    return B.written_stats(spark, f"{folder}/bundles")


# ---------------------------------------------------------------------------------------
# directory trees


@query("list_tree", _with(
    f"""SELECT path, false AS is_dir, CAST(strlen(content) AS BIGINT) AS length FROM files
        UNION ALL
        SELECT DISTINCT unnest({D.ancestors()}) AS path, true AS is_dir, CAST(NULL AS BIGINT) AS length FROM files""",
    ["files"], []))
def q_list_tree(spark, sf):
    from corpuspack.sources.tree import list_tree, write_tree

    root = scratch_path(spark, "tree")
    write_tree(Tables(spark, sf).files, root)
    return list_tree(spark, root, read_content=False).select("path", "is_dir", "length")


@query("list_tree_hidden", _with(
    f"""SELECT path, is_dir FROM nodes WHERE NOT {D.hidden('path', 'is_dir', HIDE)}""", ["nodes"], []))
def q_list_tree_hidden(spark, sf):
    """Hidden subtrees are left out while the tree is walked."""
    from corpuspack.sources.tree import list_tree, write_folders, write_tree

    root = scratch_path(spark, "tree")
    t = Tables(spark, sf)
    write_tree(t.files, root)
    write_folders(t.nodes.where("is_dir"), root)
    return list_tree(spark, root, read_content=False, hide=HIDE).select("path", "is_dir")


@query("walk_tree", _with(
    f"""SELECT path, is_dir, length FROM (
          SELECT path, false AS is_dir, CAST(strlen(content) AS BIGINT) AS length FROM files
          UNION ALL
          SELECT DISTINCT unnest({D.ancestors()}) AS path, true AS is_dir, CAST(NULL AS BIGINT) AS length FROM files)
        WHERE NOT {D.hidden('path', 'is_dir', HIDE)}""", ["files"], []))
def q_walk_tree(spark, sf):
    """The tree walked in rounds, folders dealt out again after each."""
    from corpuspack.sources.tree import walk_tree, write_tree

    root = scratch_path(spark, "tree")
    write_tree(Tables(spark, sf).files, root)
    return walk_tree(spark, root, hide=HIDE, folder_entries=50).select("path", "is_dir", "length")


@query("watch_callback", _with(
    "SELECT event_id, t_us, root, path, kind FROM ev WHERE event_id IN (SELECT event_id FROM chain)",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_watch_callback(spark, sf):
    """The watch loop end to end: every micro-batch of kept changes goes to a callback,
    which here appends it to a table."""
    folder = scratch_path(spark, "watch-callback")
    src = W.replay_source(Tables(spark, sf).change_events, f"{folder}/in")

    def on_change(df, batch_id):
        df.select("event_id", "ts", "root", "path", "kind").write.mode("append").parquet(f"{folder}/seen")

    q = W.watch(src, on_change, ignore_names=IGNORE_NAMES, ignore_paths=IGNORE_PATHS, include_names=INCLUDE_NAMES,
                gap_seconds=GAP_SECONDS, checkpoint=f"{folder}/checkpoint", trigger={"availableNow": True})
    q.awaitTermination()
    seen = spark.read.parquet(f"{folder}/seen")
    return seen.select("event_id", _t_us(seen, "ts"), "root", "path", "kind")


# ---------------------------------------------------------------------------------------
# other file sets: web pages by host, conversations in turn order


@query("pages_bundle_stats", _with(_STATS_SQL, ["page_files"],
                                   [("blocks", D.blocks_cte("page_files", True, True))]))
def q_pages_bundle_stats(spark, sf):
    pages = Tables(spark, sf).page_files
    return B.pack_stats(pages, remove_comments=True, remove_docstrings=True)


@query("pack_conversations", _with(
    """SELECT bundle, CAST(row_number() OVER (PARTITION BY bundle ORDER BY okey) - 1 AS BIGINT) AS seq,
         CAST(coalesce(sum(length(block)) OVER (PARTITION BY bundle ORDER BY okey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         path, CAST(length(block) AS BIGINT) AS n_chars, md5(block) AS block_md5
       FROM blocks""",
    ["conversation_files"],
    [("blocks", D.blocks_cte("conversation_files", okey="lpad(CAST(seq AS VARCHAR), 20, '0')"))]))
def q_pack_conversations(spark, sf):
    conv = Tables(spark, sf).conversation_files
    blocks = B.header_blocks(conv).unionByName(B.file_blocks(conv.withColumn("okey", SF.seq_key()), order="okey"))
    sized = blocks.select("bundle", "okey", "path", T.char_count("block").alias("n_chars"),
                          F.md5("block").alias("block_md5"))
    placed = O.positions(sized, "bundle", "okey", size="n_chars")
    return placed.select("bundle", "seq", "offset", "path", "n_chars", "block_md5")


# ---------------------------------------------------------------------------------------
# bundles in parts


_VIS_BLOCKS = [("vis", _VIS_FILES_SQL), ("blocks", D.blocks_cte("vis", True, True))]


@query("bundle_index", _with(
    """SELECT bundle, path, CAST(strlen(block) AS BIGINT) AS bytes, md5(block) AS block_md5,
         CAST(coalesce(sum(strlen(block)) OVER (PARTITION BY bundle ORDER BY okey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
       FROM blocks""", ["files"], _VIS_BLOCKS))
def q_bundle_index(spark, sf):
    """Where each block lies in its bundle, from the index that the write made."""
    store = PartStore(spark, scratch_path(spark, "store"), files_per_part=100, remove_comments=True, remove_docstrings=True)
    store.build(_visible_files(Tables(spark, sf)))
    return store.index().select("bundle", "path", "bytes", F.col("md5").alias("block_md5"), F.col("at").alias("byte_offset"))


@query("restore_files", _with(
    "SELECT bundle, path, md5(block) AS block_md5, CAST(length(block) AS BIGINT) AS n_chars FROM blocks WHERE is_file",
    ["files"], _VIS_BLOCKS))
def q_restore_files(spark, sf):
    """Every file cut out of its part again, by offset and size."""
    store = PartStore(spark, scratch_path(spark, "store"), files_per_part=100, remove_comments=True, remove_docstrings=True)
    vis = _visible_files(Tables(spark, sf))
    store.build(vis)
    restored = store.read_blocks(vis.where("content is not null").select("bundle", "path"))
    return restored.select("bundle", "path", F.md5("block").alias("block_md5"), T.char_count("block").alias("n_chars"))


_AFTER_SQL = """SELECT bundle, path, CASE WHEN doc_id % 10 = 5 THEN content || 'x' ELSE content END AS content
                FROM files WHERE doc_id % 10 <> 4"""


@query("watch_rebuild_parts", _with(
    """SELECT bundle, CAST(count(*) FILTER (WHERE is_file) AS BIGINT) AS n_files,
         CAST(sum(length(block) - length(replace(block, chr(10), ''))) + 1 AS BIGINT) AS n_lines,
         CAST(sum(length(block)) AS BIGINT) AS n_chars
       FROM blocks GROUP BY bundle""",
    ["files"], [("after", _AFTER_SQL), ("chosen", f"SELECT * FROM after WHERE {D.any_glob('path', SELECT_GLOBS)} AND NOT {D.hidden('path', 'false', [])}"),
                ("blocks", D.blocks_cte("chosen", True, True))]))
def q_watch_rebuild_parts(spark, sf):
    """Bundles of the first snapshot's files, kept up with the changes to the second one in several
    micro-batches that rewrite parts only: equal to a batch build of the second."""
    t = Tables(spark, sf)
    files = t.files
    before = files.where("doc_id % 10 <> 3").select("bundle", "path", "content")
    after = files.where("doc_id % 10 <> 4").select("bundle", "path", F.when(
        F.col("doc_id") % 10 == 5, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    folder = scratch_path(spark, "watch-parts")
    rebuild = W.PartRebuilder(lambda: before, S.select_glob(before, SELECT_GLOBS), f"{folder}/store", f"{folder}/state",
                              select=lambda rows: S.select_glob(rows, SELECT_GLOBS), files_per_part=100,
                              remove_comments=True, remove_docstrings=True)
    rebuild.build_all(spark)
    rebuild.files_fn = lambda: after
    changes = W.snapshot_diff(t.snapshot_a, t.snapshot_b).join(files.select("path", "bundle"), "path").select(
        F.xxhash64("path").alias("event_id"), F.timestamp_seconds(F.pmod(F.xxhash64("path"), F.lit(1000))).alias("ts"),
        F.col("bundle").alias("root"), "path", "kind", F.lit(False).alias("is_directory"))
    src = W.replay_source(changes, f"{folder}/in", chunks=3)
    W.watch(src, rebuild, checkpoint=f"{folder}/checkpoint", trigger={"availableNow": True}, coalesce=True).awaitTermination()
    return rebuild.store(spark).stats().drop("kb")


@query("throttle_feed", _with(
    "SELECT event_id, t_us, root, path, kind FROM ev WHERE event_id IN (SELECT event_id FROM chain)",
    ["change_events"], _THROTTLE_CTES, recursive=True))
def q_throttle_feed(spark, sf):
    """The throttle of a stream by the batch form, micro-batch by micro-batch."""
    ev = W.watch_filter(Tables(spark, sf).change_events, None, IGNORE_NAMES, IGNORE_PATHS, INCLUDE_NAMES)
    folder = scratch_path(spark, "throttle-feed")
    src = W.replay_source(ev.select("event_id", "ts", "root", "path", "kind"), f"{folder}/in")

    def sink(kept, batch_id):
        kept.write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")

    W.throttle_feed(src, sink, f"{folder}/state", GAP_SECONDS, trigger={"availableNow": True}).awaitTermination()
    kept = spark.read.parquet(f"{folder}/kept")
    return kept.select("event_id", _t_us(kept, "ts"), "root", "path", "kind")


_TOGGLE_SEQUENCE = """
SELECT md5(path) AS seq, path FROM shown WHERE is_dir AND length(path) - length(replace(path, '/', '')) <= 1
UNION ALL SELECT md5(concat(path, '2')) AS seq, path FROM shown WHERE is_dir AND length(path) - length(replace(path, '/', '')) = 0
UNION ALL SELECT md5(path) AS seq, path FROM files WHERE doc_id % 9 = 0
UNION ALL SELECT md5(concat(path, '2')) AS seq, path FROM files WHERE doc_id % 18 = 0"""


@query("toggle_sequence", _with(
    """SELECT unnest(sel) AS path FROM steps WHERE k = (SELECT max(k) FROM steps)""", ["nodes", "files", "selection"], [
        ("shown", f"SELECT path, is_dir FROM nodes WHERE NOT {D.hidden('path', 'is_dir', HIDE)}"),
        ("toggles", _TOGGLE_SEQUENCE),
        ("ordered", "SELECT row_number() OVER (ORDER BY seq, path) AS k, path FROM toggles WHERE path IN (SELECT path FROM shown)"),
        ("leaf", """SELECT path FROM shown s WHERE NOT is_dir OR NOT EXISTS (
                      SELECT 1 FROM shown c WHERE c.path <> s.path AND starts_with(c.path, s.path || '/'))"""),
        ("under", """SELECT k, list(leaf.path) AS leaves FROM ordered JOIN leaf
                     ON leaf.path = ordered.path OR starts_with(leaf.path, ordered.path || '/') GROUP BY k"""),
        ("steps", """SELECT CAST(0 AS BIGINT) AS k, (SELECT list(DISTINCT path) FROM selection) AS sel
             UNION ALL SELECT steps.k + 1, CASE WHEN u.leaves IS NULL THEN sel
               WHEN list_has_any(sel, u.leaves) THEN list_filter(sel, lambda x: NOT list_contains(u.leaves, x))
               ELSE list_concat(sel, u.leaves) END
             FROM steps JOIN ordered o ON o.k = steps.k + 1 LEFT JOIN under u ON u.k = o.k"""),
    ], recursive=True))
def q_toggle_sequence(spark, sf):
    """Directories, directories inside them and files toggled one after the other."""
    t = Tables(spark, sf)
    shown = S.visible_nodes(t.nodes, HIDE)
    toggles = spark.sql(_TOGGLE_SEQUENCE.replace("shown", "{shown}").replace("FROM files", "FROM {files}"), shown=shown, files=t.files)
    return S.toggle_sequence(t.selection, toggles, shown)
