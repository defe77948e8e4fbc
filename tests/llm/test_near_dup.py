"""Near-duplicates: against all pairs, with families, chains and hot groups."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuspack.llm import common
from corpuspack.llm import near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out) + 1)
        out[k:k + rng.randint(0, 1)] = [f"e{rng.randrange(1000)}"] * rng.randint(0, 1)
    return out


def families(seed):
    rng, rows = random.Random(seed), []
    for f in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 7, 30, 80, 200]))]
        texts = [base]
        for _ in range(rng.randrange(8)):  # copies of copies: chains
            texts.append(edited(rng, rng.choice(texts), rng.randrange(len(base) // 10 + 2)))
        rows += [" ".join(t) if rng.random() < 0.7 else " ".join(t).upper() + "\n" for t in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_families(documents, seed):
    rows = families(seed)
    got = N.near_duplicates(documents(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_star_whose_points_are_no_links_of_each_other(documents):
    rng = random.Random(4)
    middle = [f"m{i}" for i in range(200)]
    points = []
    for k in range(60):  # each within the threshold of the middle, not of each other
        words = list(middle)
        for at in rng.sample(range(5, 195), 4):
            words[at] = f"p{k}x{at}"
        points.append(" ".join(words))
    rows = list(enumerate([*points, " ".join(middle)]))
    want = plain_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(documents(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_blocks_of_a_bucket_meet_each_other(documents, monkeypatch, spark):
    """All pairs that differ in component, in whatever blocks, and each once."""
    import itertools

    monkeypatch.setattr(N, "BLOCK", 4)
    rng, bands, rows = random.Random(5), 2, 2
    sets = [[rng.randrange(3) for _ in range(4)] + [rng.randrange(2) for _ in range(12)] for _ in range(60)]
    sig = {i: s[:4] for i, s in enumerate(sets)}
    table = spark.createDataFrame([(i, bytearray(np.array(s[:4], "<u4").tobytes())) for i, s in enumerate(sets)], "id long, signature binary")
    members = N.in_bands(table, bands, rows).join(table, "id")
    more = spark.createDataFrame([(i, i % 5, bytearray(np.array(s[4:], "<u2").tobytes())) for i, s in enumerate(sets)], "id long, component long, more binary")
    need = [(2, 1), (4, 2), (10, 5), (16, 8)]
    got = sorted(map(tuple, N.across(members.join(more, "id"), bands, need, 4).collect()))

    def alike(i, j):
        return all(sum(a == b for a, b in zip(sets[i][:n], sets[j][:n])) >= least for n, least in need)

    want = [(i, j) for i, j in itertools.combinations(range(60), 2) if i % 5 != j % 5 and alike(i, j)
            and any(sig[i][k:k + 2] == sig[j][k:k + 2] for k in (0, 2))]
    assert got == want and len(want) > 50


def test_many_copies(documents):
    rows = [(i, "one two three four five six seven eight" if i % 3 else f"other {i} text of its own here") for i in range(600)]
    table = documents(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(table).collect()}
    assert got == {i: (1 if i % 3 else i) for i in range(600)}
    assert N.keep(table).count() == 201


def test_shingles_are_the_lower_cased_words():
    texts = ["A b C d E f", None, "", "  a b c ", "É é", "x " * 9, "ONE two", "one TWO"]
    values, border = common.shingle_sets(pa.array(texts), 5)
    assert np.diff(border).tolist() == [len(shingles(t)) for t in texts]
    assert values[border[6]:border[7]].tolist() == values[border[7]:border[8]].tolist()


def test_pruning_keeps_what_may_reach_the_threshold():
    need = N.least_matches([32, 64, 96, 128], 0.75, 1e-6)
    assert need == sorted(need) and need[-1] < 0.75 * 128
    assert N.least_matches([10], 0.5, 0.0) == [0] and N.least_matches([4], 0.5, 1.1) == [5]


def test_odd_rows(odd, empty, clashing):
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(odd).collect())
    assert rows == [(-1, 3, None, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True),
                    (6, 1, 6, True), (6, 1, 6, True)]
    assert N.near_duplicates(clashing).count() == 8 and N.near_duplicates(empty).count() == 0
    assert N.keep(odd).count() == 7  # one of the two rows of document 6
    assert N.keep(clashing).columns == clashing.columns and N.keep(empty).count() == 0


def test_one_doc_id_with_different_texts(documents):
    """Each text is judged by its own set, whichever row comes first."""
    base = [[f"{c}{k}" for k in range(80)] for c in "pqr"]
    near = [" ".join([*b[:79], "end"]) for b in base]
    p, q, r = (" ".join(b) for b in base)
    rows = [(1, p), (2, q), (2, r), (2, r), (3, near[1]), (4, near[2]), (5, near[0]), (5, "words of its own that nothing else has"), (5, None)]
    for order in (rows, rows[::-1]):
        table = documents(order, "doc_id long, text string")
        got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(table).collect()}
        assert got == {(1, 76, 1, True), (2, 76, 2, True), (3, 76, 2, False), (4, 76, 2, False), (5, 76, 1, False),
                       (5, 4, 5, True), (5, 0, 5, True)}
        assert sorted((x.doc_id, x.text or "") for x in N.keep(table).collect()) == sorted(
            [(1, p), (2, q), (2, r), (5, "words of its own that nothing else has"), (5, "")])
