"""Glob compiler against Python's fnmatch (POSIX, case-sensitive)."""

import fnmatch
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuspack.functions.patterns import glob_match, glob_to_regex, parse_patterns

GOLDEN = [
    ("*.py", "a/b.py", True), ("*.py", "a.pyc", False), ("?", "/", True), ("?", "\n", True),
    ("a*", "a\nb", True), ("[ab]", "b", True), ("[!ab]", "b", False), ("[!ab]", "c", True),
    ("[]a]", "]", True), ("[]a]", "a", True), ("[", "[", True), ("a[b", "a[b", True),
    ("[z-a]", "m", False), ("[!z-a]", "m", True), ("[\\]", "\\", True), ("\\*", "\\x", True),
    ("[a&&b]", "&", True), ("[a-c-e]", "-", True), ("[a-c-e]", "d", False), ("[a-]", "-", True),
    ("[!]", "!", False), ("[!]]", "x", True), ("*/tests/*", "x/tests/y.py", True), ("A*", "a", False),
]

_CHARS = list("ab-!]^[*?\\&/.z\n")


def _rand_glob(rng):
    return "".join(rng.choice(_CHARS) for _ in range(rng.randint(0, 7)))


def _rand_text(rng):
    return "".join(rng.choice(list("ab-!]^[\\&/.z\nc")) for _ in range(rng.randint(0, 6)))


@pytest.mark.parametrize("pat,text,expected", GOLDEN)
def test_golden_globs(pat, text, expected):
    assert fnmatch.fnmatch(text, pat) == expected
    con = duckdb.connect()
    assert con.execute("SELECT regexp_full_match(?, ?)", [text, glob_to_regex(pat)]).fetchone()[0] == expected


def test_golden_globs_spark(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in GOLDEN], "t string")
    row = df.select([glob_match(F.col("t"), p).alias(f"g{i}") for i, (p, _, _) in enumerate(GOLDEN)]).collect()
    for i, (p, t, e) in enumerate(GOLDEN):
        assert row[i][i] == e, (p, t)


def test_random_globs_re2_equal_fnmatch():
    rng = random.Random(3)
    con = duckdb.connect()
    pairs = [(_rand_glob(rng), _rand_text(rng)) for _ in range(20000)]
    got = con.execute(
        "SELECT regexp_full_match(t, r) FROM (SELECT unnest(?) AS t, unnest(?) AS r)",
        [[t for _, t in pairs], [glob_to_regex(p) for p, _ in pairs]],
    ).fetchall()
    for (p, t), (g,) in zip(pairs, got):
        assert g == fnmatch.fnmatchcase(t, p), (p, t)


def test_random_globs_spark_equal_fnmatch(spark):
    rng = random.Random(5)
    pats = [_rand_glob(rng) for _ in range(60)]
    texts = [_rand_text(rng) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[glob_match(F.col("t"), p).alias(f"g{i}") for i, p in enumerate(pats)]).collect()
    for r in rows:
        for i, p in enumerate(pats):
            assert r[i + 1] == fnmatch.fnmatchcase(r[0], p), (p, r[0])


def test_parse_patterns():
    assert parse_patterns(None) == []
    assert parse_patterns(True, "__pycache__,*.meta") == ["__pycache__", "*.meta"]
    assert parse_patterns(" *.py , ,\t*.md\n,") == ["*.py", "*.md"]
    assert parse_patterns(["a", " ", " b "]) == ["a", "b"]


def test_trailing_slash_filter_is_safe():
    from corpuspack.functions.patterns import can_match_trailing_slash

    rng = random.Random(8)
    for _ in range(3000):
        pat = _rand_glob(rng)
        if not can_match_trailing_slash(pat):
            for _ in range(20):
                assert not fnmatch.fnmatchcase(_rand_text(rng) + "/", pat), pat
    assert not can_match_trailing_slash("__pycache__") and not can_match_trailing_slash("*.meta")
    assert can_match_trailing_slash("src1[0-3]/fr/") and can_match_trailing_slash("Test_*")
    assert can_match_trailing_slash("a[!x]") and not can_match_trailing_slash("a[!/]")
