"""Keyword filters as Spark column predicates."""

import random

from pyspark.sql import functions as F

from corpuspack.functions.patterns import keyword_filter, should_ignore, should_include


def _eval(spark, rows, pred_fn):
    df = spark.createDataFrame(rows, "filename string, rel_path string")
    return [r[0] for r in df.select(pred_fn(F.col("filename"), F.col("rel_path")).alias("x")).collect()]


def test_no_include_keyword_keeps_all(spark):
    assert _eval(spark, [("b.go", "a/b.go"), ("", "")], lambda n, p: should_include(n, [])) == [True, True]


def test_include_needs_one_keyword_in_the_name(spark):
    rows = [(n, "orders/" + n) for n in ("invoice.sql", "old_invoice_2.sql", "refund.sql", "Invoice.sql", "orders.sql")]
    assert _eval(spark, rows, lambda n, p: should_include(n, ["invoice", "ref"])) == [True, True, True, False, False]


def test_a_name_keyword_looks_at_the_name_only(spark):
    rows = [("draft_plan.md", "notes/draft_plan.md"), ("plan.md", "draft/plan.md"), ("~plan.md", "notes/~plan.md")]
    assert _eval(spark, rows, lambda n, p: should_ignore(n, p, ["draft", "~"], [])) == [True, False, True]


def test_a_path_keyword_looks_at_the_whole_path(spark):
    rows = [("x.rs", "app/vendor/x.rs"), ("x.rs", "app/vendored/x.rs"), ("x.rs", "app/tmp.d/x.rs")]
    assert _eval(spark, rows, lambda n, p: should_ignore(n, p, [], ["/vendor/", "tmp."])) == [True, False, True]


def test_ignore_path_keyword_misses_top_level(spark):
    # "/tests/" is a substring test on the relative path: a top-level "tests/" has no leading slash
    rows = [("a.py", "tests/a.py")]
    assert _eval(spark, rows, lambda n, p: should_ignore(n, p, [], ["/tests/"])) == [False]


def test_either_kind_of_keyword_is_enough(spark):
    rows = [("gen_api.ts", "web/gen_api.ts"), ("api.ts", "web/dist/api.ts"), ("gen_x.ts", "web/dist/gen_x.ts"), ("api.ts", "web/api.ts")]
    assert _eval(spark, rows, lambda n, p: should_ignore(n, p, ["gen_"], ["/dist/"])) == [True, True, True, False]


def test_empty_keyword_matches_everything(spark):
    rows = [("a.py", "a.py")]
    assert _eval(spark, rows, lambda n, p: should_include(n, [""])) == [True]
    assert _eval(spark, rows, lambda n, p: keyword_filter(n, p, ignore_names=[""])) == [False]


def test_keyword_tables(spark):
    import random

    from corpuspack.operators import selection as S

    rng = random.Random(2)
    paths = ["/".join(rng.choice(["src", "tests", "lib", "a", "bé", "x_y"]) for _ in range(rng.randint(1, 4)))
             + rng.choice([".py", ".js", ""]) for _ in range(300)]
    kws = ["/tests/", "lib/a", "é", "x_y/src", ".js", "zzz"]
    files = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    table = spark.createDataFrame([(k,) for k in [*kws, None, kws[0]]], "kw string")
    none = spark.createDataFrame([], "kw string")

    def got(op, keywords):
        return sorted(((r.path or "") for r in op(files, keywords, "path", "kw").collect()))

    assert got(S.anti_contains, table) == sorted(["", *(p for p in paths if not any(k in p for k in kws))])
    assert got(S.semi_contains, table) == sorted(p for p in paths if any(k in p for k in kws))
    assert len(got(S.anti_contains, none)) == len(got(S.semi_contains, none)) == 301
    blank = spark.createDataFrame([("",)], "kw string")
    assert got(S.anti_contains, blank) == [""] and len(got(S.semi_contains, blank)) == 300
    plan = S.anti_contains(files, table, "path", "kw")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_glob_tables(spark):
    import fnmatch
    import random

    from corpuspack.operators import selection as S

    rng = random.Random(3)
    parts = ["a", "b", "-", "[", "]", "!", "*", "?", "/", ".py", "x"]
    globs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(120)] + ["*", "*.py", "", "?"]
    values = ["".join(rng.choice("ab-[]!/x.") for _ in range(rng.randint(0, 6))) + rng.choice(["", ".py"]) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "path string")
    table = spark.createDataFrame([(g,) for g in [*globs, None]], "glob string")
    got = {(r.value, r.glob) for r in S.glob_matches(df, table).collect()}
    assert got == {(v, g) for v in values for g in globs if fnmatch.fnmatchcase(v, g)}


def test_parts_and_groups_of_keywords(spark, monkeypatch):
    from corpuspack.operators import selection as S

    rng = random.Random(3)
    paths = ["".join(rng.choice("abcd/é") for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [None, "same", "same"]
    words = ["".join(rng.choice("abcd/é") for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    monkeypatch.setattr(S, "KEYWORD_CHARS", 60)
    monkeypatch.setattr(S, "VALUES_PER_GROUP", 50)
    for kws in (words, words + ["", None], [None], []):
        table = spark.createDataFrame([(k,) for k in kws], "kw string")
        real = {k for k in kws if k is not None}
        got = [(r.value, r.keyword) for r in S.containing(files, "path", table, "kw").collect()]
        assert len(got) == len(set(got)) and set(got) == {(p, k) for p in set(paths) - {None} for k in real if k in p}
        some = {r.value for r in S.containing(files, "path", table, "kw", first=True).collect()}
        assert some == {p for p in set(paths) - {None} if any(k in p for k in real)}


def test_a_million_keywords(spark):
    from corpuspack.operators import selection as S

    table = spark.range(1_000_000).select(F.concat(F.lit("k"), F.hex(F.col("id") * 7919), F.lit("/")).alias("kw"))
    files = spark.range(20_000).select(F.concat(F.lit("src/"), F.hex("id"), F.lit("k"), F.hex(F.col("id") * 7919 * 3), F.lit("/x.py")).alias("path"))
    kept = S.anti_contains(files, table, "path", "kw")
    assert kept.count() == 0
    missing = files.select(F.replace("path", F.lit("k"), F.lit("q")).alias("path"))
    assert S.anti_contains(missing, table, "path", "kw").count() == 20_000


def test_a_hundred_thousand_globs(spark):
    from corpuspack.operators import selection as S

    globs = spark.range(100_000).select(F.concat(F.lit("src/*"), F.hex("id"), F.lit("?*.py")).alias("glob"))
    globs = globs.unionByName(spark.createDataFrame([("*.py",), ("*",), ("nowhere*.py",), ("src/0?.py",), ("s*y",)], "glob string"))
    files = spark.range(300).select(F.concat(F.lit("src/m"), F.hex(F.col("id") * 311), F.lit("z.py")).alias("path"))
    tried = S.glob_candidates(files, globs)
    got = {(r.value, r.glob) for r in S.glob_matches(files, globs).collect()}
    for r in files.collect():
        digits = r.path[len("src/m"):-len("z.py")]
        want = {f"src/*{digits[i:j]}?*.py" for i in range(len(digits)) for j in range(i + 1, len(digits) + 1)
                if digits[i:j][0] != "0" or j == i + 1}
        assert {g for v, g in got if v == r.path} >= {g for g in want if int(g[5:-5], 16) < 100_000} | {"*.py", "*", "s*y"}
    assert not any(g in ("nowhere*.py", "src/0?.py") for _, g in got)
    assert tried.count() < 30 * 300  # and not 100,000 for each path, though all globs end in .py


def test_shapes_of_globs():
    from corpuspack.functions.patterns import glob_shape

    assert glob_shape("src/*/m?.c*") == (["src/", "/m", ".c"], 9, "src/", "")
    assert glob_shape("*") == ([], 0, "", "") and glob_shape("a") == (["a"], 1, "a", "a") and glob_shape("[ab]x") == (["x"], 2, "", "x")
