"""Token counts of every prefix of a text, by dynamic programming over byte-pair tokens.

For a row of bytes b, let last(i) be the last token of the byte-pair encoding of b[:i]. A token
row is the encoding of its bytes exactly when each neighbouring pair is, so last(i) is the one
token t that ends at i, fits last(i - len(t)) and count(i) = count(i - len(t)) + 1. One pass over
the bytes so gives the exact count of every prefix. Texts are cut into pieces no token spans
(``tokens.spaced_pieces``), a piece's table is computed once per worker and reused.

``prefix_table`` adds to each document the table as 16-bit steps, one per code point;
``count_at`` and ``longest_within`` answer questions about any prefix from it.

Defined results: null or empty text has no step and 0 tokens; repeated rows give repeated rows;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import array
import itertools
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspack.llm import common, tokens

STEP = np.dtype("<i2")

#: The code points with Unicode's White_Space property.
WHITE_SPACE = frozenset(map(chr, [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287,
                                  12288]))

#: Pieces that are one word and marks after it, whatever the Unicode version.
_PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")


class PrefixCounter:
    """Prefix tables of pieces under one vocabulary, with bounded memos."""

    def __init__(self, name: str):
        self.tokenizer = tokens.load(name)
        self.split = self.tokenizer.pre_tokenizer
        special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.bare = Tokenizer(self.tokenizer.model)  # no pre-tokenizer: one row of byte letters
        names = list(self.tokenizer.get_vocab(with_added_tokens=False))
        # a token that its own letters don't encode to is never produced
        made = self.bare.encode_batch(names, add_special_tokens=False)
        self.known = {n for n, e in zip(names, made, strict=True) if len(e.ids) == 1}
        # the longest token that ends in the same three letters
        self.reach: dict[str, int] = {}
        for n in self.known:
            if len(n) > 2:
                self.reach[n[-3:]] = max(len(n), self.reach.get(n[-3:], 0))
        self.fits: dict[tuple[str, str], bool] = {}
        self.letters = tokens.Memo(lambda c: "".join(x for x, _ in self.split.pre_tokenize_str(c)))  # of one character
        self.ascii = {i: self.letters[chr(i)] for i in range(128)}
        self.before: tuple[str, list[int], list[str]] = ("", [0], [""])
        self.words = tokens.Memo(self.word)
        self.later = tokens.Memo(lambda rest: self.piece(" " + rest))

    def pair(self, a: str, b: str) -> bool:
        """Whether the encoding of a's and b's bytes is just these two tokens."""
        if len(self.fits) >= tokens.CACHE_ENTRIES:
            self.fits.clear()
        got = self.fits[a, b] = self.bare.encode(a + b, add_special_tokens=False).tokens == [a, b]
        return got

    def counts(self, letters: str) -> list[int]:
        """Token count of each prefix (0, 1, 2, ... byte letters) of one pre-token."""
        known, fits, reach = self.known, self.fits, self.reach
        old, count, last = self.before
        same = 0  # letters shared with the row before, whose table begins alike
        for a, b in zip(old, letters):  # noqa: B905
            if a != b:
                break
            same += 1
        count, last = count[:same + 1], last[:same + 1]
        for i in range(same + 1, len(letters) + 1):
            for begin in range(max(0, i - reach.get(letters[i - 3:i], 2)) if i > 2 else 0, i):
                t = letters[begin:i]
                if t in known:
                    if begin:
                        ok = fits.get((last[begin], t))
                        if not (self.pair(last[begin], t) if ok is None else ok):
                            continue
                    count.append(count[begin] + 1)
                    last.append(t)
                    break
        self.before = (letters, count, last)
        return count

    def word(self, text: str) -> bytes:
        """The steps of one pre-token."""
        if text in ("'ll", "'re", "'ve"):  # cut short, the mark and the letter stand alone
            return np.diff([0, 1, 2, self.counts(text)[-1]]).astype(STEP).tobytes()
        if text.isascii():
            count = self.counts(text.translate(self.ascii))
        else:
            letters = list(map(self.letters.__getitem__, text))
            count = self.counts("".join(letters))
            if len(count) > len(text) + 1:
                count = [count[e] for e in itertools.accumulate(map(len, letters), initial=0)]
        return array.array("h", map(operator.sub, count[1:], count)).tobytes()

    def piece(self, text: str) -> bytes:
        """The steps of one piece: how the count changes at each of its code points."""
        out, begin = [], 0
        for m in self.special.finditer(text):
            part, at = text[begin:m.end()], m.start() - begin
            cut = np.cumsum(np.frombuffer(self.sections(part), STEP), dtype=np.int64)  # cut short: ordinary text
            cut[-1] = (cut[at - 1] if at else 0) + 1
            if at and part[at - 1] in WHITE_SPACE:  # white space at the end of a section is whole
                cut[-1] = np.frombuffer(self.sections(part[:at]), STEP).sum() + 1
            out.append(np.diff(cut, prepend=0).astype(STEP).tobytes())
            begin = m.end()
        if begin < len(text):
            out.append(self.sections(text[begin:]))
        return b"".join(out)

    def sections(self, text: str) -> bytes:
        """Text without special strings, cut where white space begins."""
        cuts = [i for i in range(1, len(text)) if text[i] in WHITE_SPACE and text[i - 1] not in WHITE_SPACE]
        return b"".join(self.section(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))

    def section(self, text: str) -> bytes:
        """White space, then other characters."""
        plain = _PLAIN.fullmatch(text)
        if plain:
            return self.words[plain[1]] + (self.words[plain[2]] if plain[2] else b"")
        space = len(text) - len(text.lstrip("".join(WHITE_SPACE)))
        if space == len(text):
            return self.words[text]
        pretokens = [text[a:b] for _, (a, b) in self.split.pre_tokenize_str(text)]
        steps = b"".join(self.words[p] for p in pretokens)
        if space <= 1:
            return steps
        # a prefix that ends in the white space has the run up to there as one pre-token
        run = np.frombuffer(self.words[text[:space]], STEP)
        whole = np.cumsum(np.frombuffer(steps, STEP), dtype=np.int64)
        whole[:space] = np.cumsum(run, dtype=np.int64)
        return np.diff(whole, prepend=0).astype(STEP).tobytes()

    def steps(self, text: str) -> bytes:
        """The steps of a whole text, two bytes per code point."""
        return self.joined(tokens.spaced_pieces(text))

    def joined(self, pieces: list[str]) -> bytes:
        return (self.piece(pieces[0]) if pieces[0] else b"") + b"".join(map(self.later.__getitem__, pieces[1:]))

    def all_steps(self, texts: list[str]) -> Iterator[bytes]:
        """The steps of each text. New words are taken in alphabetical order, in which most of a
        word's table is that of the word before."""
        cut = [tokens.spaced_pieces(t) for t in texts]
        new = {p for pieces in cut for p in pieces[1:]} - self.later.keys()
        plain = {p: m for p, m in ((p, _PLAIN.fullmatch(" " + p)) for p in new) if m}
        for w in sorted({m[1] for m in plain.values()} - self.words.keys()):
            self.words[w]
        for p, m in plain.items():
            self.later.put(p, self.words[m[1]] + (self.words[m[2]] if m[2] else b""))
        return map(self.joined, cut)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """The worker's counter of a vocabulary."""
    if name not in _COUNTERS:
        _COUNTERS[name] = PrefixCounter(name)
    return _COUNTERS[name]


def prefix_table(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, with ``keep_steps``, steps (binary) of each document."""
    fields = "doc_id long, n_bytes long, n_tokens long" + (", steps binary" if keep_steps else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            steps = list(c.all_steps([t or "" for t in texts]))
            columns = [
                batch.column(0),
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(s, STEP).sum(dtype=np.int64)) for s in steps], pa.int64()),
            ]
            if keep_steps:
                columns.append(pa.array(steps, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "steps"][:len(columns)])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def count_at(steps: bytes, chars: int) -> int:
    """Tokens of the prefix of ``chars`` code points."""
    return int(np.frombuffer(steps, STEP)[:chars].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(steps, STEP), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def over_limit(n_tokens: Column, limit: int = 512) -> Column:
    return n_tokens > limit
