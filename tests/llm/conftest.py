"""Small document tables with the odd rows every operator must take."""

import pytest

LONG = "word " * 40_000

ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (2, None, "en", "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (None, "alpha beta gamma delta epsilon zeta eta", "de", "b", 40),
    (6, "solo", None, None, 4),
    (6, "solo", None, None, 4),  # a repeated row
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=SCHEMA, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])


@pytest.fixture(scope="session")
def clashing(odd):
    """Further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "key", "row", "class", "cell", "h", "w", "id", "band", "signature", "component_id", "kept", "host", "path",
             "start", "n_tokens", "tie", "spans", "base", "steps", "whole", "copy", "copies", "gone", "x", "line", "Doc.Id"]
    return odd.select("*", *[F.lit(7).alias(n) for n in names])
