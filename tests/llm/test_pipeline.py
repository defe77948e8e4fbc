"""The pipeline, stage by stage, against brute force on the documents that each stage is given."""

import collections
import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_decontam import plain_score, words  # noqa: E402
from test_host_rules import plain_measures  # noqa: E402
from test_near_dup import edited, plain_components  # noqa: E402
from test_source_mix import plain_targets  # noqa: E402
from test_token_file import expected  # noqa: E402


def corpus(rng):
    items = [" ".join(f"q{k}x{i}" for i in range(30)) for k in range(6)]
    rows = []
    for i in range(160):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(20, 150))]
        kind = rng.random()
        if kind < 0.15:
            w += edited(rng, rng.choice(items).split(), 4)
        elif kind < 0.3 and rows:
            w = edited(rng, rng.choice(rows)[1].split(), 2)
        elif kind < 0.4:
            w = [x + "%%" for x in w]
        elif kind < 0.45:
            w = w[:3] * 40
        rows.append((i, " ".join(w), "en", rng.choice(["a", "b", "c", "d"]), 0))
    return rows + [(500, None, "en", "a", None), (501, "", None, None, 0)], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus(random.Random(12))
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(
        f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def plain_kept(docs):
    """Base rules and the loose limits; no host of the fixture is bad enough to be suspect."""
    for i, t, *_ in docs:
        n, chars, symbols, dup, repeats = plain_measures(t)
        if n >= 50 and 100 * repeats <= 50 * n and 100 * symbols <= 5 * chars and dup == 0:
            yield i


def test_stages(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near-duplicates", "decontamination", "source mix", "token file"]

    def go(name):
        nonlocal docs
        rows = [tuple(r) for r in docs.collect()]
        docs = stages[name](spark, docs, at)
        return rows, [tuple(r) for r in docs.collect()]

    before, after = go("quality rules")
    assert sorted(r[0] for r in after) == sorted(plain_kept(before)) and len(after) < len(before)
    before, after = go("near-duplicates")
    found = plain_components([(r[0], r[1]) for r in before])
    assert sorted(r[0] for r in after) == sorted({c for _, c in found.values()}) and len(after) < len(before)
    before, after = go("decontamination")
    leaks = {r[0] for r in before if any(2 * plain_score(words(r[1]), words(x)) >= 30 for x in items)}
    assert leaks and {r[0] for r in after} == {r[0] for r in before} - leaks and docs.columns == columns
    before, after = go("source mix")
    sizes = collections.Counter()
    for r in before:
        sizes[r[3]] += len((r[1] or "").split())
    copies, target = collections.Counter(after), plain_targets(sizes)
    for r in before:
        rate = target[r[3]] / sizes[r[3]]
        assert int(rate) <= copies[r] <= min(2, int(rate) + 1)
    assert set(after) <= set(before)
    before, after = go("token file")
    got = sorted(after, key=lambda r: r[1])
    assert got == list(expected(sorted((r[0], r[1]) for r in before)))


def test_run_is_the_stages_one_after_another(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    spark.read.parquet(f"{at}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{at}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
