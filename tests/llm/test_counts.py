"""Prefix token counts: against the library on every prefix."""

import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from corpuspack.llm import prefix_counts as P  # noqa: E402
from corpuspack.llm import tokens  # noqa: E402

PARTS = [*"ab cde'  \n\t.!?1 23éßñ日本\x1c\x85\xa0 ", "'ll", "'re", " the", "<|endoftext|>", "  ", "<|endo", "ing"]


def random_text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def test_every_prefix_has_the_librarys_count():
    rng, counter, library = random.Random(8), P.counter("byte_bpe_50k.json"), tokens.load("byte_bpe_50k.json")
    for _ in range(400):
        text = random_text(rng, 24)
        counts = np.cumsum(np.frombuffer(counter.steps(text), P.STEP)).tolist() if text else []
        assert counts == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_questions_are_answered_from_the_table():
    text = "The quick brown fox, it's over the lazy dog's head 12345 times."
    steps = P.counter("byte_bpe_50k.json").steps(text)
    library = tokens.load("byte_bpe_50k.json")
    counts = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert [P.count_at(steps, i) for i in range(len(text) + 1)] == counts
    for budget in range(max(counts) + 2):
        assert P.longest_within(steps, budget) == max(i for i, c in enumerate(counts) if c <= budget)


def test_memo_bounds_do_not_change_counts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    counter, library = P.PrefixCounter("byte_bpe_50k.json"), tokens.load("byte_bpe_50k.json")
    text = " ".join(f"word{i} again" for i in range(60))
    assert np.frombuffer(counter.steps(text), P.STEP).sum() == len(library.encode(text, add_special_tokens=False).ids)


def test_table_of_odd_rows(odd, empty, clashing):
    rows = P.prefix_table(odd).collect()
    library = tokens.load("byte_bpe_50k.json")
    assert len(rows) == 8
    for r, text in ((r, t) for r in rows for i, t in [(x.doc_id, x.text) for x in odd.collect()] if i == r.doc_id):
        assert r.n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((text or "").encode()) and len(r.steps) == 2 * len(text or "")
    assert P.prefix_table(empty).count() == 0
    assert sorted(map(str, P.prefix_table(clashing, keep_steps=False).collect())) == sorted(
        map(str, P.prefix_table(odd, keep_steps=False).collect()))


def test_many_special_strings_in_a_row():
    counter = P.counter("byte_bpe_50k.json")
    library = tokens.load("byte_bpe_50k.json")
    for text in ("<|endoftext|>" * 400, "a<|endoftext|> <|endoftext|>\n b<|endoftext|><|endo"):
        counts = np.cumsum(np.frombuffer(counter.steps(text), P.STEP)).tolist()
        ends = range(1, len(text) + 1) if len(text) < 100 else range(1, len(text) + 1, 97)
        assert [counts[i - 1] for i in ends] == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in ends]
    assert np.frombuffer(counter.steps("<|endoftext|>" * 100_000), P.STEP).sum() == 100_000


def test_long_runs_without_blanks():
    rng = random.Random(5)
    counter, library = P.counter("byte_bpe_50k.json"), tokens.load("byte_bpe_50k.json")
    base = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for text in ("".join(rng.choices(base, k=300_000)), "".join(rng.choices("etaoinshr", k=100_000)), "=" * 2000, "é日" * 3000):
        assert np.frombuffer(counter.steps(text), P.STEP).sum(dtype=np.int64) == len(library.encode(text, add_special_tokens=False).ids)
