"""Comment and docstring transforms: worked cases, edge rows, property tests."""

import random

import pytest
from pyspark.sql import functions as F

from corpuspack.functions import text as T
from models import lines_of, model_extension, model_remove_docstrings, model_strip_comments, model_transform


def _run(spark, texts, exts, fn):
    df = spark.createDataFrame(list(zip(texts, exts)), "t string, e string")
    return [r[0] for r in df.select(fn(F.col("t"), F.col("e")).alias("o")).collect()]


def test_comment_prefix(spark):
    exts = sorted(T.COMMENT_SYNTAX) + ["", ".txt", ".PY"]
    df = spark.createDataFrame([(e,) for e in exts], "e string")
    assert [r[0] for r in df.select(T.comment_prefix("e")).collect()] == [T.COMMENT_SYNTAX.get(e, "#") for e in exts]


RECIPE = "{m} soup\nboil(water)  {m} slowly\n\t {m}salt\n{m}\nserve('{m} hot')\n  {m} end"


@pytest.mark.parametrize("ext", sorted(T.COMMENT_SYNTAX))
def test_whole_line_comments_go(spark, ext):
    mark = T.COMMENT_SYNTAX[ext]
    got = _run(spark, [RECIPE.format(m=mark)], [ext], T.strip_comments)[0]
    assert got == f"boil(water)  {mark} slowly\nserve('{mark} hot')\n"


@pytest.mark.parametrize("ext", ["", ".txt", ".PY", ".h"])
def test_other_extensions_keep_comments(spark, ext):
    text = RECIPE.format(m="#") + RECIPE.format(m="//")
    assert _run(spark, [text], [ext], T.strip_comments) == [text]


@pytest.mark.parametrize("quote", ['"' * 3, "'" * 3])
@pytest.mark.parametrize("block", ["  {q}one line{q}\n", "{q}\nseveral\n\nlines{q}  \n", "x = {q}begins\n and ends{q} + 1\n"])
def test_quoted_blocks_go_with_their_lines(spark, quote, block):
    text = "area = width * height\n" + block.format(q=quote) + "print(area)\n"
    got = _run(spark, [text], [".py"], lambda t, e: T.remove_docstrings(t))[0]
    assert got == "area = width * height\nprint(area)\n"


DOC_EDGE = [
    'x = """a""" + y\nkeep\n',
    'a\n"""\nb\n""" + """\nc\n',
    'code = 1; s = """open\nstill\nclose"""\nafter\n',
    'a\n"""never closed\nb\nc',
    "a\n''' then \"\"\" \nb\n'''\nc\n",
    'a\n""""\nb\n"""\nc\n',
    '# """\nx\n"""\ny\n',
    'no newline at end """x"""',
    '',
    '\n\n',
]


@pytest.mark.parametrize("text", DOC_EDGE)
def test_docstring_edges_match_model(spark, text):
    out = _run(spark, [text], [".py"], lambda t, e: T.remove_docstrings(t))[0]
    assert out == "".join(model_remove_docstrings(lines_of(text)))


COMMENT_EDGE = [
    (" # nbsp\nkeep\n", ".py"), (" # ls\nkeep\n", ".py"), ("\u0085# nel\nkeep\n", ".py"),
    ("\u001c# fs\nkeep\n", ".py"), ("\x0c# ff\nkeep\n", ".py"), ("﻿# bom\nkeep\n", ".py"),
    ("x = 1  # tail\n", ".py"), ("#!/usr/bin/env python\nx\n", ".py"), ("/* block */\n// line\nx\n", ".c"),
    ("# php hash\n// php slash\n", ".php"), ("  //x", ".go"), ("#\n#\n#", ".rb"), ("\n# a\n\n", ".py"),
]


@pytest.mark.parametrize("text,ext", COMMENT_EDGE)
def test_comment_edges_match_model(spark, text, ext):
    out = _run(spark, [text], [ext], T.strip_comments)[0]
    assert out == "".join(model_strip_comments(lines_of(text), ext))


@pytest.mark.parametrize("name,ext", [("a", ""), (".a", ""), ("a.", ""), ("a.tar.gz", ".gz"), ("..a", ".a"),
                                      ("a.PY", ".PY"), (".env.local", ".local"), ("a\nb.py", ".py")])
def test_extension(spark, name, ext):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(T.extension("n")).first()[0] == ext == model_extension(name)


def test_decode_text_edges(spark):
    raw = [b"a\r\nb\rc", b"", b"\n", b"\xef\xbb\xbfx\n", b"\xff\xfe", b"nul\x00byte", b"ok"]
    df = spark.createDataFrame([(r,) for r in raw], "b binary")
    got = [r[0] for r in df.select(T.read_text("b")).collect()]
    assert got == ["a\nb\nc", "", "\n", "﻿x\n", None, "nul\x00byte", "ok"]


def test_strict_utf8_like_python(spark):
    cases = [b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", b"a\xe2\x82\xacb",
             b"\xf0\x9f\x98\x80", b"\xef\xbf\xbf", b"\xf8\x88\x80\x80\x80", b"\xe0\x80\xaf", b"\x80"]
    df = spark.createDataFrame([(c,) for c in cases], "b binary")
    got = [r[0] for r in df.select(T.read_text("b")).collect()]

    def py(c):
        try:
            return c.decode("utf-8")
        except UnicodeDecodeError:
            return None

    assert got == [py(c) for c in cases]


def test_split_lines(spark):
    df = spark.createDataFrame([("a\nb\n\nc",), ("",), ("x\n",)], "t string")
    got = [r[0] for r in df.select(T.split_lines("t")).collect()]
    assert got == [["a\n", "b\n", "\n", "c"], [], ["x\n"]]


_ALPHABET = ["#", "//", "/", '"""', "'''", '"', "'", "\n", "\n", "\n", " ", "\t", "x", "y = 1",
             " ", " ", "\u0085", "\x0c", "\r", "﻿", "é"]


def _random_text(rng: random.Random) -> str:
    return "".join(rng.choice(_ALPHABET) for _ in range(rng.randint(0, 60)))


def test_property_transforms_equal_line_model(spark):
    rng = random.Random(7)
    exts = [".py", ".js", ".rb", ".md", "", ".php"]
    rows = [(_random_text(rng), rng.choice(exts)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string, e string")
    out = df.select(
        T.strip_comments("t", "e").alias("c"), T.remove_docstrings("t").alias("d"),
        T.transform_source(F.col("t"), F.col("e"), True, True).alias("b"),
    ).collect()
    for (t, e), r in zip(rows, out):
        assert r.c == "".join(model_strip_comments(lines_of(t), e)), (t, e)
        assert r.d == "".join(model_remove_docstrings(lines_of(t))), t
        assert r.b == model_transform(t, e, True, True), (t, e)


def test_transform_dynamic_flags_equal_static(spark):
    rows = [("# c\n\"\"\"d\"\"\"\nx\n", ".py", rc, rd) for rc in (False, True) for rd in (False, True)]
    df = spark.createDataFrame(rows, "t string, e string, rc boolean, rd boolean")
    got = df.select(T.transform_source(F.col("t"), F.col("e"), F.col("rc"), F.col("rd"))).collect()
    for (t, e, rc, rd), r in zip(rows, got):
        assert r[0] == model_transform(t, e, rc, rd)


def test_comment_prefix_from_user_table(spark):
    from corpuspack.operators.transform import with_comment_prefix

    files = spark.createDataFrame([("a.py",), ("b.lua",), ("c",), ("d.js",)], "path string")
    user = spark.createDataFrame([(".lua", "--"), (".py", ";")], "ext string, prefix string")
    got = {r.path: r.prefix for r in with_comment_prefix(files, user).collect()}
    assert got == {"a.py": ";", "b.lua": "--", "c": "#", "d.js": "#"}
    built_in = {r.path: r.prefix for r in with_comment_prefix(files).collect()}
    assert built_in == {"a.py": "#", "b.lua": "#", "c": "#", "d.js": "//"}


def test_long_lines_and_long_docstrings_do_not_overflow(spark):
    texts = [
        "x" * 1_000_000 + "\n" + '"""' + "\n",
        '"""\n' + "doc line\n" * 100_000,
        "# c\n" * 100_000 + "code\n",
        ("a = '''" + "y" * 500_000 + "'''\n") * 2,
        "  // " + "z" * 500_000 + "\nkeep\n",
    ]
    exts = [".py", ".py", ".py", ".py", ".js"]
    df = spark.createDataFrame(list(zip(texts, exts)), "t string, e string")
    rows = df.select(T.transform_source(F.col("t"), F.col("e"), True, True).alias("o")).collect()
    for t, e, r in zip(texts, exts, rows):
        assert r.o == model_transform(t, e, True, True)
