"""Mixing sources: targets by filling up step by step, systematic samples."""

import collections
import random

import pytest

from corpuspack.llm import source_mix as S


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if level * weight[n] > most * sizes[n]]
        if not over:
            return out | {n: level * weight[n] for n in open_}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            open_.discard(n)
    return out


def rows_of(rng, sources, most=200):
    return [(i, " ".join("w" * rng.randint(0, most)) or "", "en", rng.choice(sources), 0) for i in range(400)]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_samples(documents, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, ["a", "b", "c", "d", None, "é", "Z"][: 3 + 2 * seed])
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    want = plain_targets(sizes)
    got = S.mix(documents(rows, parts=5), carry=["doc_id", "source"]).collect()
    assert len(got) == 400
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source]
        assert int(rate) <= r.copies <= min(2, int(rate) + 1)
        taken[r.source] += r.size * r.copies
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 200 + 0.05 * want[source]


def test_reruns_and_partitionings_agree(documents):
    rows = rows_of(random.Random(9), ["a", "b", "c"])
    runs = [sorted(map(tuple, S.mix(documents(rows, parts=p)).collect())) for p in (2, 7)]
    assert runs[0] == runs[1]
    emitted = collections.Counter(r.doc_id for r in S.emit(documents(rows)).collect())
    assert emitted == {r[0]: r[4] for r in runs[0] if r[4]}


def test_one_size_and_one_source(documents):
    rows = [(i, "a b c", "en", "s", 0) for i in range(500)]
    got = S.mix(documents(rows)).collect()
    assert abs(sum(r.copies for r in got) - 750) <= 1


def test_odd_rows(odd, empty, clashing):
    rows = S.mix(odd).collect()
    assert len(rows) == 8 and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert sorted(map(str, S.mix(clashing).collect())) == sorted(map(str, rows))
    assert S.mix(empty).count() == 0 and S.emit(empty).count() == 0
    assert S.emit(clashing).columns == clashing.columns
    nothing = odd.where("doc_id in (2, 3, 4)")
    assert {(r.target, r.copies) for r in S.mix(nothing).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("cell_rows", [20_000, 30, 7])
def test_samples_equal_a_plain_running_sum(documents, cell_rows):
    """Per source: the copies of its rows, put in the order in which they were taken, are the
    integers that the plain running sum from the source's offset crosses."""
    rng = random.Random(cell_rows)
    rows = [(None if i % 3 else i // 2, "w " * rng.choice([0, 3, 3, 3, 40]) + rng.choice("ab"), None, rng.choice(["s", "t", None]), i % 2)
            for i in range(600)] + [(None, "the same row", "en", "s", 1)] * 300
    got = S.mix(documents(rows), carry=["doc_id", "text", "lang", "source", "n_chars"], cell_rows=cell_rows).collect()
    key = lambda r: tuple(map(str, (r[0], r[1], r[2], r[3], r[4])))
    assert sorted(map(key, got)) == sorted(map(key, rows))
    for source in ("s", "t", None):
        mine = [r for r in got if r.source == source]
        rate = mine[0].target / mine[0].source_size
        total = sum(r.copies for r in mine)
        assert abs(total - rate * len(mine)) <= 1 and {r.copies for r in mine} <= {int(rate), int(rate) + 1}
        # neighbours in size make up for each other: so does any class of sizes as a whole
        for size in {r.size for r in mine}:
            some = [r.copies for r in mine if r.size == size]
            assert abs(sum(some) - rate * len(some)) <= 1 + 1e-9
    emitted = S.emit(documents(rows), cell_rows=cell_rows).collect()
    assert collections.Counter(map(key, emitted)) == sum((collections.Counter({key(r): r.copies}) for r in got), collections.Counter())


@pytest.mark.parametrize("cell_rows", [20_000, 7])
def test_null_ids_repeats_and_ties_agree_between_partitionings(documents, cell_rows):
    rows = [(None, f"a b {i % 50}", "en", "s", 0) for i in range(200)] + [(7, f"c d {i}", "en", "t", i) for i in range(100)]
    runs = [sorted(map(str, S.emit(documents(rows, parts=p), cell_rows=cell_rows).collect())) for p in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) > 300


def test_no_cell_grows_with_the_rows(documents):
    """Null ids of one size spread over cells; equal rows are one row of the numbering."""
    docs = documents([(None, f"a b {i}", "en", "s", 0) for i in range(1000)] + [(None, "x y z", "en", "s", 0)] * 1000)
    hashes = docs.select(S.row_hash(docs, docs.columns, 1).alias("h")).collect()
    cells = collections.Counter(r.h % 10 for r in set(hashes))
    assert len(set(hashes)) == 1001 and max(cells.values()) < 200
