"""Alignment of two tokenizers' tokens over the same texts, by the byte offsets their tokens end at.

The ends of either tokenizer's tokens are a rising list. The shorter list drives a galloping search
into the longer one: from a guess, steps that double until the value is passed, then halving between
the last two places. All its values gallop at once, so a step is one array operation over those that
still search. What it finds is each end's rank in the longer list. Ends that are in both lists cut the
tokens into groups; the differences between ranks of neighbouring ends are the ranges of tokens of the
other list that a token overlaps, its links.

How often two ids are linked is a number of the whole corpus, so documents are aligned in slices of
bounded text. A slice numbers the different id pairs it has and counts them; a document keeps these
numbers with how often it has them. Only the slices' counts are added up by pair - a pair that every
document has is one row per slice -, and each slice gets the corpus counts of its pairs back, in a
cogroup by slice with its documents. Texts are encoded once, by pieces of which a worker keeps the ids,
and aren't shuffled.

Defined results: a text that is null or empty, or whose tokens don't spell it out exactly, has no
tokens, so zeros and no groups; null ids and repeated rows are kept; ties for a B id's most frequent
partner all count as best; a text of any length is encoded whole (a slice ends after it); other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspack.llm import common
from corpuspack.llm.tokens import CACHE_ENTRIES, spaced_pieces, vocabulary
from corpuspack.session import materialize

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"

#: Bytes of text that are encoded at once, and that a slice has about (a longer text is alone).
ENCODE_BYTES = 1 << 20
SLICE_BYTES = 16 << 20


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable characters of
    Latin-1 for themselves, the other bytes in order for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder_a(name: str):
    """Encoder of a list of texts (each after a space), the bytes of each id and their number."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(name if "/" in name else vocabulary(name))
    tokenizer.encode_special_tokens = True  # their strings are ordinary text
    symbols = byte_symbols()
    spelled = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        spelled[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return encode, spelled, np.array([len(x) for x in spelled], np.int64)


@functools.lru_cache(maxsize=4)
def encoder_b(name: str):
    """Encoder of a list of texts (the model adds the space), the bytes of each id and their number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else vocabulary(name))
    spelled = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else
               model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    alone = model.encode("a ")[len(model.encode("a")):]  # a space and nothing after it

    def encode(texts: list[str]) -> list[list[int]]:
        return [ids if t else alone for ids, t in zip(model.encode(texts, num_threads=1), texts, strict=True)]

    return encode, spelled, np.array([len(x) for x in spelled], np.int64)


class Side:
    """The ids of one tokenizer for numbered pieces, end to end."""

    def __init__(self, encode, spelled: list[bytes], length: np.ndarray):
        self.encode, self.spelled, self.length = encode, spelled, length
        self.ids, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, texts: list[str]) -> list[bool]:
        """Encodes the pieces that come next; whether each is spelled out by its tokens."""
        ids = self.encode(texts)
        counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.int64, count=int(counts.sum()))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
        spell = self.spelled.__getitem__
        return [b"".join(map(spell, x)) == (" " + t).encode() for x, t in zip(ids, texts, strict=True)]

    def tokens(self, which: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, their number in each text, and the byte offsets they end at (over all texts)."""
        count = self.first[which + 1] - self.first[which]
        ids = self.ids[ranges(self.first[which], count)]
        return ids, np.bincount(text, weights=count, minlength=n_texts).astype(np.int64), np.cumsum(self.length[ids])


class Pieces:
    """Both tokenizers' ids of texts, by pieces that are encoded once (an exact memo that is emptied
    when it holds ``CACHE_ENTRIES`` pieces).

    Texts are cut where a space follows other than white space: the byte-level tokenizer begins a word
    there, and no piece of the other model goes on after such a space, as none has one behind another
    character; so the ids of the pieces, end to end, are the text's. A model that has such a piece
    gets whole texts.
    """

    def __init__(self, a: str, b: str):
        self.sides = (Side(*encoder_a(a)), Side(*encoder_b(b)))
        self.whole = any(b" " in x.lstrip(b" ") for x in self.sides[1].spelled)
        self.known: dict[str, int] = {}
        self.exact = np.zeros(0, bool)

    def cut(self, text: str) -> list[str]:
        return [text] if self.whole else spaced_pieces(text)

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The pieces' numbers, new ones encoded; valid up to the next call."""
        if len(self.known) > CACHE_ENTRIES or len(self.sides[0].ids) > 16 * CACHE_ENTRIES:
            self.known, self.exact = {}, np.zeros(0, bool)
            self.sides = tuple(Side(s.encode, s.spelled, s.length) for s in self.sides)
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            one, other = (side.add(new) for side in self.sides)
            self.exact = np.concatenate((self.exact, np.array(one) & np.array(other)))
        return np.fromiter(map(self.known.__getitem__, texts), np.int64, count=len(texts))


@functools.lru_cache(maxsize=2)
def pieces(a: str, b: str) -> Pieces:
    return Pieces(a, b)


def gallop(values: np.ndarray, into: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Rank of each value: how many entries of the rising list ``into`` are smaller. The search for a
    value starts at its guess; a good one costs two comparisons."""
    n = len(into)
    ended = np.append(into, np.iinfo(np.int64).max)
    at = np.clip(guess, 0, n)
    low, high = np.empty_like(at), np.empty_like(at)  # entry low is smaller (or -1), entry high isn't
    smaller = ended[at] < values

    up = np.flatnonzero(smaller)
    low[up], step = at[up], 1
    while len(up):
        to = np.minimum(low[up] + step, n)
        go = ended[to] < values[up]
        high[up[~go]] = to[~go]
        up = up[go]
        low[up], step = to[go], 2 * step

    down = np.flatnonzero(~smaller)
    high[down], step = at[down], 1
    while len(down):
        to = np.maximum(high[down] - step, -1)
        go = (to >= 0) & (ended[to] >= values[down])
        low[down[~go]] = to[~go]
        down = down[go]
        high[down], step = to[go], 2 * step

    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) >> 1
        less = ended[middle] < values[wide]
        low[wide[less]] = middle[less]
        high[wide[~less]] = middle[~less]
        wide = wide[high[wide] - low[wide] > 1]
    return high


def intersect(short: np.ndarray, long: np.ndarray, first_short: np.ndarray, first_long: np.ndarray):
    """Of the ends of many texts' tokens (rising over all texts; each text ends in both lists): whether
    each short end is a long one too, and the first and last long token that each short one overlaps.

    ``first_short`` and ``first_long`` have the number of each text's first token, and the lists'
    lengths at the end.
    """
    n_short, n_long = np.diff(first_short), np.diff(first_long)
    begin = np.repeat(first_short[:-1], n_short)
    slope = np.repeat(n_long / np.maximum(n_short, 1), n_short)
    guess = np.repeat(first_long[:-1], n_short) + ((np.arange(len(short)) - begin) * slope).astype(np.int64)
    rank = gallop(short, long, guess)
    common = long[rank] == short
    first = np.zeros_like(rank)
    first[1:] = rank[:-1] + common[:-1]
    return common, first, rank


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - count - first, count)


class Aligned:
    """The alignment of some texts: ids and ends of both sides, groups and links."""

    def __init__(self, texts: list[str | None], a: str, b: str):
        encoded = pieces(a, b)
        cut = [encoded.cut(t) if t else [] for t in texts]
        n = np.array([len(x) for x in cut], np.int64)
        which = encoded.numbers([p for x in cut for p in x])
        # a text of which a piece isn't spelled out has no tokens
        text = np.repeat(np.arange(len(cut)), n)
        wrong = np.zeros(len(cut), bool)
        wrong[text[~encoded.exact[which]]] = True
        which, text = which[~wrong[text]], text[~wrong[text]]
        (self.ids_a, self.n_a, self.ends_a), (self.ids_b, self.n_b, self.ends_b) = (
            side.tokens(which, text, len(cut)) for side in encoded.sides)
        self._link()

    def _link(self) -> None:
        """``last_a`` and ``last_b``: whether a token is its group's last; ``link_text``, ``link_a``,
        ``link_b``: the text and the ids of each link."""
        self.first_a, self.first_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        self.last_a, self.last_b = np.zeros(len(self.ids_a), bool), np.zeros(len(self.ids_b), bool)
        found = []
        for a_drives in (True, False):  # in each text the side with fewer tokens
            chosen = np.flatnonzero((self.n_a <= self.n_b) == a_drives)
            pick_a, pick_b = (ranges(first[chosen], n[chosen]) for first, n in ((self.first_a, self.n_a), (self.first_b, self.n_b)))
            sides = [(self.ends_a, pick_a, self.n_a), (self.ends_b, pick_b, self.n_b)]
            (short, pick_s, n_s), (long, pick_l, n_l) = sides if a_drives else sides[::-1]
            if not len(pick_s):
                continue
            common, first, last = intersect(short[pick_s], long[pick_l], *(
                np.concatenate(([0], np.cumsum(n[chosen]))) for n in (n_s, n_l)))
            count = last - first + 1
            one, other = np.repeat(pick_s, count), pick_l[ranges(first, count)]
            found.append((np.repeat(np.repeat(chosen, n_s[chosen]), count), *((one, other) if a_drives else (other, one))))
            flags = (self.last_a, self.last_b) if a_drives else (self.last_b, self.last_a)
            flags[0][pick_s], flags[1][pick_l[last[common]]] = common, True
        text, at_a, at_b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 3))
        self.link_text, self.link_a, self.link_b = text, self.ids_a[at_a], self.ids_b[at_b]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        n = len(self.n_a)
        groups = np.bincount(np.repeat(np.arange(n), self.n_a)[self.last_a], minlength=n)
        return groups.astype(np.int64), np.bincount(self.link_text, minlength=n).astype(np.int64)

    def groups(self) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        before_b = np.concatenate(([0], np.flatnonzero(self.last_b) + 1))  # B tokens of the groups before
        until_a = np.flatnonzero(self.last_a) + 1  # A tokens up to the end of a group
        parts = np.empty(len(self.ids_a) + len(self.ids_b), object)
        most = int(max(self.ids_a.max(initial=0), self.ids_b.max(initial=0))) + 1
        text = numbers(1 << most.bit_length())
        parts[np.arange(len(self.ids_a)) + before_b[group_a]] = text[np.where(self.last_a, 1, 0), self.ids_a]
        if len(until_a):
            parts[np.arange(len(self.ids_b)) + until_a[group_b]] = text[np.where(self.last_b, 2, 0), self.ids_b]
        at = self.first_a + self.first_b
        return ["".join(parts[s:e])[:-1] for s, e in zip(at.tolist(), at[1:].tolist())]


@functools.lru_cache(maxsize=4)
def numbers(n: int) -> np.ndarray:
    """The decimal numbers below n, followed by a comma, a bar or a semicolon."""
    return np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], object)


class Pairs:
    """Numbers of the id pairs of a slice, in the order they came, and how often each came."""

    def __init__(self):
        self.keys = np.zeros(0, np.int64)  # rising
        self.number = np.zeros(0, np.int64)  # of each key
        self.times = np.zeros(0, np.int64)  # by number

    def add(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The numbers of some different, rising keys that came so often."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        numbers = np.empty(len(keys), np.int64)
        numbers[~new] = self.number[at[~new]]
        numbers[new] = len(self.keys) + np.arange(int(new.sum()))
        self.keys, self.number = np.insert(self.keys, at[new], keys[new]), np.insert(self.number, at[new], numbers[new])
        self.times = np.concatenate((self.times, np.zeros(int(new.sum()), np.int64)))
        self.times[numbers] += times
        return numbers

    def by_number(self) -> np.ndarray:
        out = np.empty_like(self.keys)
        out[self.number] = self.keys
        return out


ROWS = "slice long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, numbers array<int>, pairs array<long>, times array<long>"


def _lists(values: np.ndarray, border: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(values, kind))


def _doc_rows(ids: pa.Array, aligned: Aligned, pairs: Pairs, part: int, groups: list[str]) -> pa.RecordBatch:
    n = len(ids)
    key = aligned.link_a << 32 | aligned.link_b
    keys, which = np.unique(key, return_inverse=True)
    numbers = pairs.add(keys, np.bincount(which, minlength=len(keys)))
    own, times = np.unique(aligned.link_text * max(len(keys), 1) + which, return_counts=True)
    text, which = np.divmod(own, max(len(keys), 1))
    border = np.searchsorted(text, np.arange(n + 1))
    n_groups, n_links = aligned.counts()
    none = np.zeros(n + 1, np.int64)
    columns = [np.full(n, part, np.int64), np.ones(n, bool), ids, aligned.n_a, aligned.n_b, n_groups, n_links, pa.array(groups, pa.string()),
               _lists(numbers[which], border, pa.int32()), _lists(none[:0], none, pa.int64()), _lists(times, border, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[x.split()[0] for x in ROWS.split(", ")])


def _slice_row(pairs: Pairs, part: int) -> pa.RecordBatch:
    border = np.array([0, len(pairs.keys)])
    nothing = pa.array([None], pa.int64())
    columns = [pa.array([part], pa.int64()), pa.array([False]), *[nothing] * 5, pa.array([None], pa.string()),
               pa.array([None], pa.list_(pa.int32())), _lists(pairs.by_number(), border, pa.int64()), _lists(pairs.times, border, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def alignments(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, digest: bool = False) -> DataFrame:
    """A row per document (its numbers, groups, and the id pairs of its links by their number in the
    slice) and one per slice (its pairs and their counts); ``digest``: the groups' sha256 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark import TaskContext

        part, done, pairs = TaskContext.get().partitionId() << 32, 0, Pairs()
        for batch in common.slices(batches, limit=ENCODE_BYTES):
            texts = batch.column(1).to_pylist()
            aligned = Aligned(texts, a, b)
            groups = aligned.groups()
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            yield _doc_rows(batch.column(0), aligned, pairs, part, groups)
            done += batch.column(1).nbytes
            if done >= SLICE_BYTES:
                yield _slice_row(pairs, part)
                part, done, pairs = part + 1, 0, Pairs()
        if done:
            yield _slice_row(pairs, part)

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def slice_pairs(rows: DataFrame) -> DataFrame:
    """slice, number, pair, n: the id pairs of each slice."""
    return rows.where("not is_doc").select("slice", F.posexplode(F.arrays_zip("pairs", "times"))).select(
        "slice", F.col("pos").alias("number"), F.col("col.pairs").alias("pair"), F.col("col.times").alias("n"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, count (links of the whole corpus), best (whether no other pair of b has more)."""
    counts = slice_pairs(rows).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))})
    # a B id has at most as many partners as A has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _judged(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of a slice with sums over the corpus counts of its pairs."""
    docs = docs.combine_chunks()
    size = counted.num_rows
    at = counted["number"].to_numpy()
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[at], best[at] = counted["count"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
    length = docs["numbers"].combine_chunks().value_lengths().to_numpy()
    which = docs["numbers"].combine_chunks().flatten().to_numpy()
    times = docs["times"].combine_chunks().flatten().to_numpy()
    filled = np.flatnonzero(length)
    first = (np.cumsum(length) - length)[filled]
    out = {}
    for name, value in (("n_best", best), ("count_sum", count)):
        total = np.zeros(len(length), np.int64)
        if len(filled):
            total[filled] = np.add.reduceat(times * value[which], first)
        out[name] = pa.array(total)
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.table([out.get(n, docs[n] if n not in out else None) for n in names], names=names)


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id),
    count_sum (the corpus counts of all links), groups, of each row of docs."""
    rows = materialize(alignments(docs, a, b, digest), "token-alignments")
    counts = materialize(pair_counts(rows), "token-pairs")
    back = slice_pairs(rows).join(counts, "pair").select(F.col("slice").alias("of"), "number", "count", "best")
    own = rows.where("is_doc").drop("is_doc", "pairs")
    return own.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_judged, RESULT)
