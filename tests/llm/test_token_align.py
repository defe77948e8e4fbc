"""Token alignment against byte ranges compared one by one, and the galloping search against counting."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuspack.llm import token_align as T
from corpuspack.llm.tokens import vocabulary

A = Tokenizer.from_file(vocabulary(T.TOKENIZER_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=vocabulary(T.TOKENIZER_B))


def spelled_a(i):
    # the decoder gives bytes that are no character by themselves as a mark, so bytes come by the symbols
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in keep)}
    return bytes(symbol[c] for c in A.id_to_token(i))


def spelled_b(i):
    piece = B.id_to_piece(i)
    return bytes.fromhex(piece[3:5]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """ids of A and B, groups, and the linked pairs of ids, by comparing the tokens' byte ranges."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    sides = []
    for ids, spell in ((a, spelled_a), (b, spelled_b)):
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return [], [], [], []
        at, side = 0, []
        for i in ids:
            side.append((at, at + len(spell(i)), i))
            at = side[-1][1]
        sides.append(side)
    cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
    groups, links = [[[], []] for _ in cuts], []
    for k, side in enumerate(sides):
        for _, e, i in side:
            groups[bisect.bisect_left(cuts, e)][k].append(i)
    for s, e, x in sides[0]:
        k = bisect.bisect_right(sides[1], s, key=lambda r: r[1])
        while k < len(sides[1]) and sides[1][k][0] < e:
            links.append((x, sides[1][k][2]))
            k += 1
    return a, b, groups, links


def plain_rows(rows):
    told = [(doc_id, *plain(text)) for doc_id, text in rows]
    count = Counter(p for *_, links in told for p in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    for doc_id, a, b, groups, links in told:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text)


TEXTS = ["", None, "hello world", " leading and  double   spaces ", "\n\ttabs\n\n and lines\r\n", "naïve café 日本語 текст 😀😀", "▁ a real mark ▁", "<s> </s> <unk> <|endoftext|> <0x0A>",
         "a" * 3000, "=" * 999, "x\0y", "internationalisation antidisestablishmentarianism", " ", "é", "12345678901234567890 3.14159", "http://a.b/c?d=e&f=g#h", "ａ① ﬁ ﬂ 　​.",
         "ab " * 600, "é" * 50, "Tokenizers tokenise tokens, don't they?"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["the", "of", "Straße", "cœur", "tokens", "unbelievably", "42", "日本", "x=y;", "\n", "", "don't", "ÑANDÚ", "…", "()", "zzyzx"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(120)]
    return list(enumerate(TEXTS + made + made[:5])) + [(None, "the of the"), (3, "repeated"), (3, "repeated")]


@pytest.mark.parametrize("slice_bytes", [1, 16 << 20])
def test_against_all_pairs(documents, rows, monkeypatch, slice_bytes):
    monkeypatch.setattr(T, "SLICE_BYTES", slice_bytes)
    docs = documents(rows, "doc_id long, text string")
    want = sorted(map(repr, plain_rows(rows)))
    assert sorted(repr(tuple(r)) for r in T.align(docs).collect()) == want
    digests = [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in plain_rows(rows)]
    assert sorted(repr(tuple(r)) for r in T.align(docs, digest=True).collect()) == sorted(map(repr, digests))


def test_gallop_counts_smaller_entries():
    rng = np.random.default_rng(3)
    for n, m in [(0, 5), (5, 0), (1, 1), (100, 1000), (1000, 100), (3000, 3000)]:
        into = np.unique(rng.integers(0, 5000, m))
        values = np.sort(rng.integers(-5, 5005, n))
        for guess in (np.zeros(n, np.int64), np.full(n, m + 7), rng.integers(-3, m + 3, n)):
            assert (T.gallop(values, into, guess) == [(into < v).sum() for v in values]).all()


def test_pair_counts(documents, rows):
    told = T.pair_counts(T.alignments(documents(rows, "doc_id long, text string"))).collect()
    count = Counter(p for _, text in rows for p in plain(text)[3])
    assert {(r.a, r.b): r["count"] for r in told} == dict(count)
    assert all(r.best == (r["count"] == max(n for (_, y), n in count.items() if y == r.b)) for r in told[:200])


def test_pairs_keep_their_numbers():
    pairs, seen = T.Pairs(), {}
    rng = np.random.default_rng(4)
    total = Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 300, 50))
        times = rng.integers(1, 9, len(keys))
        for k, n, t in zip(keys.tolist(), pairs.add(keys, times).tolist(), times.tolist()):
            assert seen.setdefault(k, n) == n
            total[k] += t
    assert {k: int(pairs.times[n]) for k, n in seen.items()} == dict(total)
    assert pairs.by_number().tolist() == sorted(seen, key=seen.get)


def test_odd_rows(odd, clashing, empty):
    want = sorted(repr(tuple(r)) for r in T.align(odd).collect())
    assert want == sorted(map(repr, plain_rows([(r.doc_id, r.text) for r in odd.collect()])))
    assert sorted(repr(tuple(r)) for r in T.align(clashing).collect()) == want
    assert T.align(empty).collect() == []


def test_long_text_is_whole(documents):
    text = "the quick brown fox jumps " * 100_000
    r = T.align(documents([(1, text)], "doc_id long, text string"), digest=True).first()
    assert r.n_a == len(A.encode(" " + text, add_special_tokens=False).ids) and r.n_b == len(B.encode(text))
    assert r.n_links == r.n_a + r.n_b - r.n_groups
