"""Line dedup: edit distances and the join against all pairs."""

import collections
import random
import re

import numpy as np
import pytest

from corpuspack.llm import line_dedup as L


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        k = rng.randint(0, len(out))
        kind = rng.randrange(3)
        if kind == 0 or not out:
            out.insert(k, rng.choice(letters))
        elif kind == 1:
            del out[k - 1]
        else:
            out[k - 1] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    b = [changed(rng, x, rng.randint(0, 5), "abc") for x in a]
    points = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in s] for s in (a, b)]
    assert L.edit_distance(*points, edits).tolist() == [min(plain_distance(x, y), edits + 1) for x, y in zip(a, b)]


def plain_classes(rows, edits=2, chars=25):
    seen = [(d, n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    first = {}
    for d, n, x in sorted(seen, key=lambda r: r[:2]):
        first.setdefault(x, (d, n))
    links, leads, lines = collections.Counter(), dict.fromkeys(first, True), list(first)
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            t = min(edits, max(len(a), len(b)) // chars)
            if t and abs(len(a) - len(b)) <= t and plain_distance(a, b) <= t:
                links[a] += 1
                links[b] += 1
                leads[max(a, b, key=first.get)] = False
    copies = collections.Counter(x for _, _, x in seen)
    return {(d, n): (*first[x], copies[x], links[x], first[x] == (d, n) and leads[x]) for d, n, x in seen}


@pytest.mark.parametrize("edits, chars, letters", [(2, 25, "abcdefgh éß"), (3, 10, "ab "), (1, 8, "abcd")])
def test_classes_and_links(documents, edits, chars, letters):
    rng, lines = random.Random(edits), []
    for _ in range(60):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(6, 80)))
        lines += [base, *(changed(rng, base, rng.randint(0, edits + 1), letters) for _ in range(rng.randrange(4)))]
    rng.shuffle(lines)
    lines += ["  ", "", "\x0b", "x"]
    docs = []
    while lines:
        k = rng.randint(1, 6)
        docs.append("\n".join(lines[:k]))
        lines = lines[k:]
    rows = list(enumerate([*docs, None, "", docs[0]]))
    got = L.line_classes(documents(rows, "doc_id long, text string"), edits, chars).collect()
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line, r.copies, r.n_links, r.kept) for r in got} == plain_classes(rows, edits, chars)


def test_memo_bound_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(L, "SEEN", 3)
    rows = [(i, f"a line of some length that differs in number {i % 7} only\nshared by all of them, word for word") for i in range(60)]
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 2 and {r.copies for r in got if r.line == 1} == {60}


def test_odd_rows(odd, empty, clashing):
    rows = sorted((r.doc_id or 0, r.line, r.copies, r.kept) for r in L.line_classes(odd).collect())
    assert rows == [(0, 0, 1, True), (1, 0, 1, True), (5, 0, 1, True), (6, 0, 2, True), (6, 0, 2, True)]
    assert L.line_classes(clashing).count() == 5 and L.line_classes(empty).count() == 0


def spread_edits(rng, text, edits, letters):
    """One edit in the middle of each of ``edits`` like parts."""
    out, n = list(text), len(text)
    for i in reversed(range(edits)):
        k = (2 * i + 1) * n // (2 * edits)
        out[k:k + 1] = rng.choice([[], [out[k], rng.choice(letters)], [rng.choice([x for x in letters if x != out[k]])]])
    return "".join(out)


def test_edits_grow_with_the_line(documents):
    rng, lines = random.Random(7), []
    for n in (19, 20, 39, 41, 100, 198, 200, 333, 600):
        for _ in range(3):
            base = "".join(rng.choice("abcdefgh éß") for _ in range(n - 1)) + "z"
            lines += [base, *(spread_edits(rng, base, n // 20 + more, "abcdefgh éß") for more in (0, 1))]
    lines += ["word " * 60, "word " * 61, "word " * 64, "a" * 100, "a" * 105, "a" * 106]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    expected = plain_classes(rows, 10**9, 20)
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line, r.copies, r.n_links, r.kept) for r in got} == expected
    assert sum(e[3] for e in expected.values()) >= 2 * 3 * 8


def test_one_replaced_word_in_a_usual_line(documents):
    words = "the committee agreed that another meeting about the new bridge would take place before the end of winter " * 2
    rows = [(1, words), (2, words.replace("bridge", "theatre", 1)), (3, words.replace("committee", "parliament"))]
    got = {r.doc_id: (r.n_links, r.kept) for r in L.line_classes(documents(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (0, True)


def test_a_line_longer_than_rows_can_tell(documents):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh éß") for _ in range(70_000))
    rows = [(1, base), (2, "x" * 900 + base[500:69_000]), (3, base[::-1])]
    got = {r.doc_id: (r.n_links, r.kept) for r in L.line_classes(documents(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (0, True)}


def test_hot_grams_are_dealt_in_blocks(documents, monkeypatch):
    rows = [(i, f"Posted on Monday morning by the user {i * 7919 % 1000:03d}") for i in range(60)]
    expected = plain_classes(rows, 10**9, 20)
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "ABOVE_MEAN", 0)
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line, r.copies, r.n_links, r.kept) for r in got} == expected


def test_blocks_of_a_place_are_bounded(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 100)
    blocks = L.block_counts(np.array([0.5, *[1e-9] * 4095], np.float32), 4000)
    assert blocks[0] == 20 and set(blocks[1:].tolist()) == {1}
    key = np.random.default_rng(1).integers(0, 1 << 63, 2000, np.uint64)
    place, of = L.in_blocks(np.full(2000, 5, np.uint64), key, np.full(2000, 20))
    assert np.unique(place, return_counts=True)[1].max() < 300
    met = np.zeros((2000, 2000), bool)
    for p in np.unique(place):
        met[np.ix_(of[place == p], of[place == p])] = True
    assert met.all()


def test_distances_of_many_texts():
    rng = random.Random(11)
    a = ["".join(rng.choice("abé ÿ€") for _ in range(rng.choice((0, 1, 9, 40, 90)))) for _ in range(500)]
    b = [changed(rng, x, rng.randint(0, 30), "ab€") for x in a]
    edits = np.array([rng.randint(0, 64) for _ in a])
    expected = [min(plain_distance(x, y), t + 1) for x, y, t in zip(a, b, edits.tolist())]
    assert L.edit_distance(a, b, edits).tolist() == expected
    assert [L.distance(x, y, t) for x, y, t in zip(a, b, edits.tolist())] == expected


def test_linked_lines_share_a_chosen_gram():
    """With the fewest characters in common that t edits can leave, whatever the order of grams."""
    rng = random.Random(5)
    for n in (20, 38, 39, 40, 59, 60, 100, 199, 200, 380, 410):
        for seed in range(20):
            a = "".join(rng.choice("abcdefgh") for _ in range(n))
            b = spread_edits(rng, a, n // 20, "abcdefgh")
            if plain_distance(a, b) > max(len(a), len(b)) // 20:
                continue
            both = []
            for text in (a, b):
                lines = L.Lines([text])
                gram = lines.grams(9)
                order = (L.common.mix(gram + np.uint64(seed)) >> np.uint64(34)).astype(np.uint32) + np.uint32(1)
                at, _ = L.chosen_grams(lines, np.arange(1), order, 9, None, 20)
                both.append(set(gram[at].tolist()))
            assert both[0] & both[1], (a, b)


def test_a_shared_gram_alone_is_no_candidate():
    """Lines of one length with one gram in common at one place, and nothing beside it."""
    rng = random.Random(2)
    lines = L.Lines(["".join(rng.choice("abcdefgh") for _ in range(50)) + "QRSTUVWXY" + "".join(rng.choice("abcdefgh") for _ in range(50))
                     for _ in range(200)])
    at, n = lines.start + 50, np.zeros(200)
    fields = [n, np.arange(200), n + 109, n + 50, n, L.around(lines, at, 9)]
    data = b"".join(x.astype(kind).tobytes() for x, (_, kind) in zip(fields, L.FIELDS))
    assert sum(p.shape[1] for p in L.pairs_within([data], 1 << 62, None, 20)) < 0.1 * 200 * 199 / 2


@pytest.mark.parametrize("bands", [1, 6])
def test_bands_lose_no_link(documents, monkeypatch, bands):
    rng, lines = random.Random(bands), []
    for n in range(20, 420, 8):
        base = "".join(rng.choice("abcdefgh éß") for _ in range(n))
        lines += [base, *(spread_edits(rng, base, n // 20 + more, "abcdefgh éß") for more in (0, 1))]
    rows = [(i // 3, x) for i, x in enumerate(lines)]
    rows = [(i, "\n".join(x for j, x in rows if j == i)) for i in range(len(lines) // 3)]
    monkeypatch.setattr(L, "BANDS", bands)
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line, r.copies, r.n_links, r.kept) for r in got} == plain_classes(rows, 10**9, 20)


def test_shuffled_files_go_with_each_written_table(documents, monkeypatch):
    seen, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: (seen.append(df.sparkSession.conf.get(L.CLEANED)), write(df, name))[1])
    docs = documents([(1, "one line of text in a document\nand another one")], "doc_id long, text string")
    before = docs.sparkSession.conf.get(L.CLEANED, None)
    assert L.line_classes(docs).count() == 2 and set(seen) == {"true"}
    assert docs.sparkSession.conf.get(L.CLEANED, None) == before


def test_a_stretch_in_common_gives_a_pair_once():
    """Not once for each of its grams."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(800))
    lines = L.Lines([base, spread_edits(rng, base, 3, "abcdefgh")])
    gram, size = lines.grams(9), lines.end - lines.start
    order = (L.common.mix(gram) >> np.uint64(34)).astype(np.uint32) + np.uint32(1)
    at, line = L.chosen_grams(lines, np.arange(2), order, 9, None, 20)
    first, last, line, gram, near_by = L.held_rows(lines, at, line, gram[at], 9)
    fields = [gram & np.uint64((1 << 32) - 1), line, size[line], first - lines.start[line], last - first, near_by]
    data = b"".join(x.astype(kind).tobytes() for x, (_, kind) in zip(fields, L.FIELDS, strict=True))
    shared = len(set(gram[line == 0].tolist()) & set(gram[line == 1].tolist()))
    pairs = np.concatenate([*L.pairs_within([data], 1 << 62, None, 20)], axis=1)
    assert shared > 60 and 1 <= pairs.shape[1] <= 8 and {tuple(p) for p in pairs.T.tolist()} == {(0, 1)}


def test_a_repeated_gram_hides_no_pair():
    """Rows of a gram that a line has several times tell nothing of what is before it."""
    lines = L.Lines(["abcdefghi" + "x" * 30 + "abcdefghi" + "y" * 30])
    at = lines.start[0] + np.array([0, 39, 48])
    first, last, _, gram, near_by = L.held_rows(lines, at, np.zeros(3, np.int64), lines.grams(9)[at], 9)
    told = dict(zip((first - lines.start[0]).tolist(), zip((last - first).tolist(), (near_by >> np.uint64(32)).tolist())))
    assert told[0] == (39, 0) and told[48][0] == 0 and told[48][1] > 0 and len(set(gram.tolist())) == 2


def test_lines_with_one_id_are_told_apart(documents, monkeypatch):
    rng, lines = random.Random(8), []
    for n in range(20, 300, 12):
        base = "".join(rng.choice("abcdefgh éß") for _ in range(n))
        lines += [base, *(spread_edits(rng, base, n // 20 + more, "abcdefgh éß") for more in (0, 1))]
    rows = list(enumerate(lines))
    monkeypatch.setattr(L, "ID_BITS", 3)
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line, r.copies, r.n_links, r.kept) for r in got} == plain_classes(rows, 10**9, 20)


@pytest.mark.parametrize("letters", ["ab", "abcé ", "aÿ€", "ab\U0001F600", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))])
def test_distances_by_many_letters_and_edits(letters):
    rng = random.Random(len(letters))
    a = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 9, 63, 64, 65, 130, 200)))) for _ in range(200)]
    b = [changed(rng, x, rng.choice((0, 3, 20, 80)), letters) for x in a]
    edits = np.array([rng.choice((0, 3, 4, 10, 62, 63, 100, 300)) for _ in a])
    expected = [min(plain_distance(x, y), t + 1) for x, y, t in zip(a, b, edits.tolist())]
    assert L.edit_distance(a, b, edits).tolist() == expected


def test_texts_of_one_doc_id(documents):
    """The same rows again under one id and under none: their lines are verified once."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh") for _ in range(200))
    near = spread_edits(rng, base, 6, "abcdefgh")
    rows = [(d, t) for d in (None, 7) for t in (base, base + "\n" + near, near, base)]
    got = L.line_classes(documents(rows, "doc_id long, text string")).collect()
    assert len(got) == 10 and {(r.copies, r.n_links) for r in got} == {(6, 1), (4, 1)}
