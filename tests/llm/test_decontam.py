"""Decontamination: against aligning every item with every whole text."""

import random
import re

import numpy as np

from corpuspack.llm import decontam as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").lower())


def plain_score(text, item):
    """Smith-Waterman, cell by cell."""
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (1 if v == w else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def table(rng, n):
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 20, 40, 60]))) for _ in range(25)]
    docs = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        if rng.random() < 0.6:
            copy = rng.choice(items).split()
            for _ in range(rng.randrange(len(copy) // 3 + 1)):
                k = rng.randrange(len(copy))
                copy[k:k + 1] = rng.choice([[], ["x"], [copy[k], "y"]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy[rng.randrange(2) * len(copy) // 3:]
        docs.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    return docs, items


def promised(text, item):
    """Leaks that the seeds can't miss: at most a quarter of the words replaced or missing."""
    return 2 * plain_score(text, item) >= len(item)


def test_alignment_scores():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 15))] for _ in range(2))
        code = {c: i for i, c in enumerate("abcd")}
        got, end = D.align(*(np.array([code[c] for c in s]) for s in (a, b)))
        assert got == plain_score(a, b) and end <= len(a)


def test_leaks_are_found_and_no_others(documents):
    docs, items = table(random.Random(7), 150)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    bench = documents(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(rows), bench).collect()}
    want = {(i, k) for i, t in enumerate(docs) for k, item in enumerate(items)
            if len(words(item)) >= 5 and promised(words(t), words(item))}
    assert {g for g in got if len(items[g[1]].split()) >= 5} == want
    kept = {r.doc_id for r in D.clean(documents(rows), bench).collect()}
    assert kept == set(range(150)) - {d for d, _ in got}


def test_parts_of_the_benchmark_find_the_same(documents):
    docs, items = table(random.Random(3), 80)
    table_ = documents([(i, t, "en", "s", 0) for i, t in enumerate(docs)])
    bench = documents(list(enumerate(items)), "item_id long, text string")
    whole, parts = (sorted(map(tuple, D.contaminated(table_, bench, n).collect())) for n in (10**6, 300))
    assert whole == parts
    assert sorted(r.doc_id for r in D.clean(table_, bench, 300).collect()) == sorted(r.doc_id for r in D.clean(table_, bench).collect())


def test_a_passage_in_most_documents_is_still_found(documents):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} " + item + f" c{i}", "en", "s", 0) for i in range(90)] + [(90 + i, f"clean text {i}", "en", "s", 0) for i in range(10)]
    bench = documents([(1, item), (2, "never seen words in any text at all")], "item_id long, text string")
    assert {r.doc_id for r in D.contaminated(documents(rows), bench).collect()} == set(range(90))


def test_odd_rows(odd, empty, clashing, documents):
    bench = documents([(1, None), (2, ""), (None, "beta gamma delta epsilon zeta"), (4, "solo"), (4, "solo")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in D.contaminated(odd, bench).collect())
    assert got == [(0, 0), (1, 0), (6, 4), (6, 4), (6, 4), (6, 4)]
    assert sorted(r.doc_id for r in D.clean(odd, bench).collect()) == [2, 3, 4, 5]
    assert D.clean(clashing, bench).columns == clashing.columns
    none = documents([], "item_id long, text string")
    assert D.contaminated(odd, none).count() == 0 and D.clean(odd, none).count() == 8
    assert D.contaminated(empty, bench).count() == 0 and D.clean(empty, bench).count() == 0


def test_added_words_and_short_items_are_found(documents):
    rng, rows, items = random.Random(11), [], []
    for m in (3, 4, 5, 8, 15, 16, 40, 59):
        item = [f"i{m}x{k}" for k in range(m)]
        items.append(" ".join(item))
        added = [w for k, v in enumerate(item) for w in ([v, f"new{k}"] if k % 2 and k + 1 < m else [v])]
        replaced = [f"other{k}" if k % 4 == 2 and k < 4 * (m // 4) else v for k, v in enumerate(item)]
        apart = [*item[:m // 2], *[f"gap{k}" for k in range(m // 2)], *item[m // 2:]]
        for _ in range(2):
            for copy in (added, replaced, apart):
                rows.append(" ".join([f"a{rng.randrange(99)}" for _ in range(9)] + copy + ["end"] * rng.randrange(3)))
    rows += ["a b X d e", "a b c d e", "a X Y d e"]
    items.append("a b c d e")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(
        documents([(i, t, "en", "s", 0) for i, t in enumerate(rows)]),
        documents(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(i, k) for i, t in enumerate(rows) for k, item in enumerate(items) if promised(words(t), words(item))}
    assert len(got) >= 6 * 7


def test_hits_of_common_words_stay_bounded(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)

    def zipf(n):
        return [f"w{k}" for k in np.minimum(rng.zipf(1.2, n), 20_000)]

    items = [" ".join(zipf(30)) for _ in range(2000)]
    text = zipf(30_000)
    text[9000:9000] = items[77].split()
    texts = pa.array([" ".join(text), " ".join(zipf(3000)) + " " + items[5]])
    made = D.Items.make(list(range(len(items))), items)
    _, _, seeds = made.places(D.common.word_hashes(D.common.text_bytes(texts)[0])[0])
    known = np.unique(made.seeds)
    made = made.rarest(dict(zip(known.view(np.int64).tolist(), np.bincount(seeds, minlength=len(known)).tolist())))
    peak, found = {}, {}
    for limit in (50_000, 10**9):
        monkeypatch.setattr(D, "HITS", limit)
        tracemalloc.start()
        found[limit] = sorted(made.leaks(texts))
        peak[limit] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert found[50_000] == found[10**9] and {(0, 77), (1, 5)} <= {g[:2] for g in found[10**9]}
    assert 2 * peak[50_000] < peak[10**9]
