"""Bundle assembly, exact bytes and the ordered sink."""

import glob
import os
import random

from pyspark.sql import functions as F

from corpuspack.operators import bundle as B
from corpuspack.operators.ordering import positions
from corpuspack.sources.files import explicit_list, seq_key
from models import model_bundle

SHOP = '"""Prices of the shop."""\nVAT = 1.2\n  # tax in\ndef gross(net):\n    return net * VAT  # rounded later\n'
CART = "import shop\n\ntotal = 0\n\'\'\'\nnot run:\ntotal = 1\n\'\'\'\nprint(total)"
STYLE = "// colours\nlet red = '#f00';\n"
TREE = [("lib/cart.py", CART), ("lib/shop.py", SHOP), ("web/style.js", STYLE)]


def _files(spark, tree=TREE, bundle="proj"):
    return spark.createDataFrame([(bundle, f"{bundle}/{p}", t) for p, t in tree], "bundle string, path string, content string")


def _packed(blocks):
    return "".join(r.block for r in blocks.orderBy("bundle", "okey").collect())


def test_pack_is_the_files_between_markers(spark):
    blocks = B.pack(_files(spark))
    assert _packed(blocks) == model_bundle("proj", TREE)[0]
    assert B.processed_count(blocks).first().n_processed == len(TREE)


def test_pack_of_transformed_files(spark):
    text = _packed(B.pack(_files(spark), remove_comments=True, remove_docstrings=True))
    assert text == model_bundle("proj", TREE, comments=True, docstrings=True)[0]
    bodies = ["import shop\n\ntotal = 0\nprint(total)", "VAT = 1.2\ndef gross(net):\n    return net * VAT  # rounded later\n", "let red = '#f00';\n"]
    assert all(f" ====\n{body}\n# ==== END" in text for body in bodies)


def test_bundle_explicit_subset_in_list_order(spark):
    files = _files(spark).drop("bundle")
    paths = spark.createDataFrame([("b", 2, "proj/lib/shop.py"), ("b", 1, "proj/lib/cart.py"),
                                   ("b", 3, "proj/lib/cart.py"), ("b", 4, "proj/lib"), ("b", 5, "proj/nope.py")],
                                  "bundle string, seq int, path string")
    dirs = spark.createDataFrame([("proj/lib",)], "path string")
    found, rejects = explicit_list(files, paths, dirs)
    blocks = B.file_blocks(found.withColumn("okey", seq_key()), root=F.lit(""), order="okey")
    text = "".join(r.block for r in blocks.orderBy("okey").collect())
    expect = model_bundle("", [("proj/lib/cart.py", CART), ("proj/lib/shop.py", SHOP), ("proj/lib/cart.py", CART)])[0]
    assert text == expect.split("\n\n", 1)[1]
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [(4, "is a directory"), (5, "not found")]


def test_stats_equal_packed_text(spark):
    blocks = B.pack(_files(spark), remove_comments=True)
    text = _packed(blocks)
    st = B.bundle_stats(blocks).first()
    assert (st.n_files, st.n_lines, st.n_chars) == (3, text.count("\n") + 1, len(text))
    assert st.kb == float(f"{len(text) / 1024:.1f}")


def _read_back(out_dir, bundle):
    parts = sorted(glob.glob(os.path.join(out_dir, f"bundle={bundle}", "part-*")))
    return "".join(open(p, encoding="utf-8", newline="").read() for p in parts), len(parts)


def test_write_round_trip_byte_exact_many_ranges(spark, tmp_dir):
    rng = random.Random(1)
    tree = [(f"d{rng.randint(0, 4)}/sub{rng.randint(0, 3)}/f{i:03d}{rng.choice(['.py', '.js', '', '.md'])}",
             "".join(rng.choice(["# c\n", "x = 1\n", '"""d"""\n', "// s\n", "é\r\n", "\n"]) for _ in range(8)))
            for i in range(150)]
    files = _files(spark, tree, "big").unionByName(_files(spark, tree[:20], "small"))
    blocks = B.pack(files, remove_comments=True, remove_docstrings=True)
    out = os.path.join(tmp_dir, "out")
    B.write_bundles(blocks, out, num_ranges=7)
    for name, sub in (("big", tree), ("small", tree[:20])):
        got, n_parts = _read_back(out, name)
        order = sorted(sub, key=lambda pt: [(i == len(pt[0].split("/")) - 1, c.lower(), c)
                                            for i, c in enumerate(pt[0].split("/"))])
        assert got == model_bundle(name, order, comments=True, docstrings=True)[0]
    assert _read_back(out, "big")[1] > 1  # the big bundle really spans several tasks
    ws = {r.bundle: r for r in B.written_stats(spark, out).collect()}
    bs = {r.bundle: r for r in B.bundle_stats(blocks).collect()}
    assert {k: (v.n_lines, v.n_chars) for k, v in ws.items()} == {k: (v.n_lines, v.n_chars) for k, v in bs.items()}


def test_empty_selection_writes_nothing(spark, tmp_dir):
    files = _files(spark)
    out = os.path.join(tmp_dir, "keep")
    os.makedirs(out)
    open(os.path.join(out, "old.txt"), "w").write("old")
    empty = spark.createDataFrame([], "path string")
    assert B.build_bundles(files, empty, out) is None
    assert os.listdir(out) == ["old.txt"]
    sel = spark.createDataFrame([("proj/lib/shop.py",)], "path string")
    st = B.build_bundles(files, sel, out).collect()
    assert [(r.bundle, r.n_lines) for r in st] == [("proj", model_bundle("proj", TREE[1:2])[0].count("\n") + 1)]


def test_positions_match_window_with_hot_group(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 30)}", f"k{rng.randint(0, 10**9):010d}",
             rng.randint(1, 50)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, k string, s long")
    got = {(r.g, r.k): (r.seq, r.offset) for r in positions(df, "g", "k", size="s", num_ranges=9).collect()}
    by_g = {}
    for g, k, s in sorted(rows):
        by_g.setdefault(g, []).append((k, s))
    for g, items in by_g.items():
        off = 0
        for i, (k, s) in enumerate(items):
            assert got[(g, k)] == (i, off)
            off += s


def test_create_bundle_api_counts_and_rejects(spark, tmp_dir):
    files = _files(spark).drop("bundle")
    paths = spark.createDataFrame([("out", 1, "proj/lib/cart.py"), ("out", 2, "proj/lib/shop.py"),
                                   ("out", 3, "proj/missing.py")], "bundle string, seq int, path string")
    out = os.path.join(tmp_dir, "cb")
    n, rejects = B.create_bundle(files, paths, out, root=F.lit("proj"), remove_comments=True)
    assert n == 2 and [r.path for r in rejects.collect()] == ["proj/missing.py"]
    got, _ = _read_back(out, "out")
    assert got == model_bundle("proj", [("lib/cart.py", CART), ("lib/shop.py", SHOP)], comments=True)[0]


def test_marker_by_extension(spark):
    files = spark.createDataFrame([("b", "b/x.js", "a\n"), ("b", "b/y.py", "c\n")], "bundle string, path string, content string")
    text = _packed(B.pack(files, marker="by_extension"))
    assert "// ==== BEGIN FILE: x.js ====\na\n\n// ==== END FILE: x.js ====" in text
    assert "# ==== BEGIN FILE: y.py ====" in text and text.startswith("# Files combined from: b\n\n")


def test_line_array_api(spark):
    import corpuspack as cp

    lines = ["# c\n", "def f():\n", '    """d"""\n', "    return 1\n"]
    df = spark.createDataFrame([(lines, ".py")], "l array<string>, e string")
    r = df.select(cp.apply_transformations("l", "e", True, True).alias("a"),
                  cp.strip_single_line_comments("l", "e").alias("b"),
                  cp.remove_python_docstrings("l").alias("c"), cp.get_comment_prefix("e").alias("p")).first()
    assert r.a == ["def f():\n", "    return 1\n"]
    assert r.b == lines[1:]
    assert r.c == [lines[0], lines[1], lines[3]]
    assert r.p == "#"


def test_one_bundle_holding_everything_matches_duckdb(spark, tmp_dir):
    """Skew extreme on the driver data: every file in one bundle, written over several
    ranges, equals DuckDB's single ordered string_agg of the same blocks."""
    import duckdb

    from tables import SF001 as SF001_DIR
    from corpuspack.plans import duck as D
    from corpuspack.plans.fixtures import DUCK_FILES, Tables

    files = Tables(spark, SF001_DIR).files.withColumn("bundle", F.lit("all"))
    out = os.path.join(tmp_dir, "one")
    n = B.write_bundles(B.pack(files, remove_comments=True, remove_docstrings=True), out, num_ranges=6)
    got, n_parts = _read_back(out, "all")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001_DIR}/documents.parquet')")
    sql = (f"WITH files AS ({DUCK_FILES}), src AS (SELECT 'all' AS bundle, path, content FROM files), "
           f"blocks AS ({D.blocks_cte('src', True, True)}) "
           "SELECT string_agg(block, '' ORDER BY okey), count(*) FILTER (WHERE is_file) FROM blocks")
    expect, n_files = con.execute(sql).fetchone()
    assert n_parts > 1 and n == n_files
    assert got == expect


def test_pack_stats_in_one_pass(spark):
    files = _files(spark).unionByName(spark.createDataFrame(
        [("none", "none/x.py", None), ("proj", "proj/bad.py", None)], "bundle string, path string, content string"))
    for kw in ({}, {"remove_comments": True, "remove_docstrings": True}, {"root": F.lit("proj")}):
        want = {tuple(r) for r in B.bundle_stats(B.pack(files, **kw)).collect()}
        assert {tuple(r) for r in B.pack_stats(files, **kw).collect()} == want
    assert {r.bundle: r.n_files for r in B.pack_stats(files).collect()} == {"proj": 3, "none": 0}


def test_the_write_makes_each_block_once(spark, tmp_dir):
    from pyspark.sql import Observation

    rows = [(f"b{i % 3}", f"b{i % 3}/f{i}.py", f"x = {i}\n") for i in range(500)]
    files = spark.createDataFrame(rows, "bundle string, path string, content string")
    seen = Observation("files")
    observed = files.observe(seen, F.count(F.lit(1)).alias("n"))
    n = B.write_bundles(B.file_blocks(observed), os.path.join(tmp_dir, "once"), 5, keys=B.file_keys(files))
    assert n == 500 and seen.get["n"] == 500


def test_range_numbers(spark):
    keys = spark.createDataFrame([("b", f"{i:03d}") for i in range(0, 200, 2)] + [(None, "x")], "bundle string, okey string")
    for n in (1, 3, 10, 60):
        starts = B.range_starts(keys, n).first().starts
        rows = B.with_range(keys.unionByName(spark.createDataFrame([("a", "0"), ("b", "001"), ("c", "")], keys.schema)),
                            starts, "r").collect()

        def order(r):
            return (r.bundle is not None, r.bundle or "", r.okey)
        for r in rows:
            assert r.r == max(0, sum(order(s) <= order(r) for s in starts) - 1)


def test_a_hundred_thousand_ranges(spark):
    keys = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("bundle"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("okey"))
    starts = B.range_starts(keys, 100_000).first().starts
    assert 90_000 < len(starts) <= 100_000
    sizes = B.with_range(keys, starts, "r").groupBy("r").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("bundle", "okey")).alias("lo"), F.max(F.struct("bundle", "okey")).alias("hi")).orderBy("r").collect()
    assert sum(r.n for r in sizes) == 400_000 and max(r.n for r in sizes) < 40
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(sizes, sizes[1:]))


def test_ranges_are_even_and_the_same_in_each_run(spark):
    keys = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "big").otherwise("b").alias("bundle"), F.hex("id").alias("okey"))
    starts = B.range_starts(keys.repartition(7), 20).first().starts
    sizes = [r["count"] for r in B.with_range(keys, starts, "r").groupBy("r").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2.5 * sum(sizes) / 20
    assert starts == B.range_starts(keys.repartition(3), 20).first().starts


def test_null_groups_have_positions(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("g", "c"), ("g", "d")], "g string, k string")
    got = sorted((r.g or "", r.k, r.seq) for r in positions(df, "g", "k", num_ranges=3).collect())
    assert got == [("", "a", 0), ("", "b", 1), ("g", "c", 0), ("g", "d", 1)]


def test_undecodable_listed_files_are_told_apart(spark):
    files = spark.createDataFrame([("a", "x"), ("b", None)], "path string, content string")
    paths = spark.createDataFrame([("o", 1, "a"), ("o", 2, "b"), ("o", 3, "c")], "bundle string, seq int, path string")
    found, rejects = explicit_list(files, paths)
    assert [r.path for r in found.collect()] == ["a"]
    assert sorted((r.seq, r.reason) for r in rejects.collect()) == [(2, "not valid UTF-8"), (3, "not found")]
