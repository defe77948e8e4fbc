"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A test item of m words leaks into a text if the best local alignment of their words (match 1,
other word, missing word or added word -1; ASCII letters lower-cased) scores at least half of m,
which an exact copy does with up to a quarter of its words replaced or missing, or up to half as
many words added to it.

With e words replaced, missing or added, a leak matches at least m/2 + e words in at most e + 1
runs, so it keeps at least m/2 - 1 of the item's two-word seeds, whatever e is. So the item's seeds
that most documents of the corpus hold can be left out, as long as the ones left out are fewer than
that: of each item the rarest seeds are kept, and a text is aligned only where it holds ``need`` of
them, none more than 3m/2 words (what a leak can stretch over) after the one before. Nothing is
lost by it, however common a leaked passage is.

The items' word hashes are sent to the executors in parts of at most ``part_words`` words (a
bound on what is broadcast); a larger benchmark takes one more scan of the corpus for each part.
A scan has no shuffle: a text's seeds, windows and alignments are found where the text is read.
Documents are counted by different seeds, a place of a text being at most one seed of each width.
Hits are places of a text with the items that have their seed, so a common seed of many items gives
places times items of them; they are made for some items at a time, ``HITS`` or those of one item (no
more than the text has places), so that memory is bounded by the slice of text and the part of items.

Defined results: null or empty texts and items without words match nothing; an item shorter than
three words is one seed of all its words; null ids are passed on; repeated rows and items are
found each time; other columns are not read (``clean`` passes them on); an empty benchmark or
table gives no leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuspack.llm import common

SEED_WORDS = 2
#: Bytes of text looked through at once.
SLICE = 1 << 20
#: Places of texts with items of their seed that are held at once (some 50 bytes each).
HITS = 2_000_000
#: Words of test items sent to the executors at once (16 bytes each).
PART_WORDS = 2_000_000


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on (as many as there are whole grams)."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = common.mix(total + hashes[k:k + n] * np.uint64(2 * k + 1) + np.uint64(width))
    return total


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local score of the two word rows, and the place after the text's last aligned word."""
    at = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, 1, -1))
        row = np.maximum.accumulate(new + at) - at  # added words
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


@dataclass
class Items:
    """Word hashes of test items, end to end, and their seeds sorted by hash."""

    names: list
    words: np.ndarray
    border: np.ndarray
    seeds: np.ndarray  # sorted, with repeats: one entry for each place in an item
    seed_item: np.ndarray
    seed_at: np.ndarray
    need: np.ndarray  # per item
    widths: tuple[int, ...]

    @classmethod
    def make(cls, names: list, texts: list[str | None]) -> Items:
        data, at = common.text_bytes(pa.array(texts, pa.string()))
        words, start, _ = common.word_hashes(data)
        border = np.searchsorted(start, at)
        seeds, item, place = [], [], []
        for i, (a, b) in enumerate(zip(border, border[1:], strict=False)):
            if b > a:
                g = grams(words[a:b], min(SEED_WORDS, b - a))
                seeds.append(g)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        lengths = np.diff(border)
        promised = np.maximum(1, -(-lengths // 2) - 1)  # seeds that a copy keeps at least
        out = cls(names, words, border, *(np.concatenate(x) if x else np.zeros(0, t) for x, t in (
            (seeds, np.uint64), (item, np.int64), (place, np.int64))), promised,
            tuple(sorted({int(min(SEED_WORDS, n)) for n in lengths if n})))
        return out.of(np.argsort(out.seeds, kind="stable"))

    def of(self, order: np.ndarray) -> Items:
        return Items(self.names, self.words, self.border, self.seeds[order], self.seed_item[order], self.seed_at[order],
                     self.need, self.widths)

    def rarest(self, documents: dict[int, int]) -> Items:
        """Without each item's most common seeds, by numbers of documents; up to three are needed."""
        need = np.minimum(self.need, 3)
        df = np.array([documents.get(int(s), 0) for s in self.seeds.view(np.int64)], np.int64)
        order = np.lexsort((self.seed_at, -df, self.seed_item))  # most common first within an item
        item = self.seed_item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = np.sort(order[rank >= (self.need - need)[item]])
        out = self.of(kept)
        out.need = need
        return out

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different seeds, and the places of a word row that are one of them with its number."""
        known = np.unique(self.seeds)
        table = np.zeros(1 << 20, bool)
        table[(known & np.uint64(len(table) - 1)).astype(np.int64)] = True
        where, number = [], []
        for width in self.widths:
            g = grams(words, width)
            maybe = np.flatnonzero(table[(g & np.uint64(len(table) - 1)).astype(np.int64)])
            at = np.searchsorted(known, g[maybe])
            found = np.zeros(len(at), bool)
            found[at < len(known)] = known[at[at < len(known)]] == g[maybe][at < len(known)]
            where.append(maybe[found])
            number.append(at[found])
        return (known, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, number)))

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """place, seed (by number), item, and how often the item has the seed, for some items at a time."""
        known, place, number = self.places(words)
        order = np.argsort(number, kind="stable")
        place, number = place[order], number[order]
        # an item's equal seeds are one entry
        entry = np.stack((np.searchsorted(known, self.seeds), self.seed_item))
        entry, times = np.unique(entry, axis=1, return_counts=True) if entry.shape[1] else (entry, np.zeros(0, np.int64))
        held = np.bincount(number, minlength=len(known))[entry[0]]
        entry, times, held = entry[:, held > 0], times[held > 0], held[held > 0]
        total = np.bincount(entry[1], weights=held, minlength=len(self.names))
        batch = (np.cumsum(total) // HITS).astype(np.int64)[entry[1]]  # by item
        by = np.argsort(batch, kind="stable")
        for mine in np.split(by, np.flatnonzero(np.diff(batch[by])) + 1) if len(by) else ():
            n = held[mine]
            first = np.searchsorted(number, entry[0, mine])
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            which = np.repeat(mine, n)
            yield place[at], entry[0, which], entry[1, which], times[which]

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """text, item, score, first and end word of the window for each leak, by text and item."""
        data, at = common.text_bytes(texts)
        words, start, _ = common.word_hashes(data)
        first = np.searchsorted(start, at)
        lengths = np.diff(self.border)
        for place, seed, item, times in self.hits(words):
            text = np.searchsorted(first, place, "right") - 1
            inside = place + np.minimum(SEED_WORDS, lengths)[item] <= first[text + 1]
            order = np.lexsort((place, item, text))
            order = order[inside[order]]
            text, item, place, seed, times = text[order], item[order], place[order], seed[order], times[order]
            new = np.ones(len(text), bool)  # a group: hits of one item that lie close together
            new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > (lengths + lengths // 2)[item[1:]])
            begin = np.append(np.flatnonzero(new), len(text))
            # a seed that the item has more than once counts as often, but each only once
            enough = np.flatnonzero(np.add.reduceat(times, begin[:-1]) >= self.need[item[begin[:-1]]]) if len(text) else ()
            for g in enough:
                a, b = begin[g], begin[g + 1]
                i, t = item[a], text[a]
                different = np.unique(seed[a:b], return_index=True)[1]
                if times[a:b][different].sum() < self.need[i]:
                    continue
                reach = lengths[i] + lengths[i] // 2 + 1
                x, y = max(first[t], place[a] - reach), min(first[t + 1], place[b - 1] + reach)
                score, end = align(words[x:y], self.words[self.border[i]:self.border[i + 1]])
                if 2 * score >= lengths[i]:
                    yield int(t), int(i), score, int(x - first[t]), int(x - first[t] + end)


def parts(items: DataFrame, part_words: int) -> Iterator[Items]:
    """The test items, so many words at a time."""
    rows = items.select("item_id", "text", F.length("text").alias("chars"))
    chars = rows.agg(F.sum("chars")).first()[0] or 0
    count = max(1, -(-chars // (2 * part_words)))  # a word takes two characters at least
    for k in range(count):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text")
        got = mine.select("item_id", "text").collect()
        yield Items.make([r["item_id"] for r in got], [r["text"] for r in got])


def document_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """Number of documents that hold each seed (one row per seed of the part)."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.unique(sent.value.seeds)
        total = np.zeros(len(seeds), np.int64)
        for batch in common.slices(batches, text=0, limit=SLICE):
            data, at = common.text_bytes(batch.column(0))
            words, start, _ = common.word_hashes(data)
            _, place, seed = sent.value.places(words)
            text = np.searchsorted(np.searchsorted(start, at), place, "right") - 1
            seen = np.unique(text * len(seeds) + seed) % max(1, len(seeds))
            total += np.bincount(seen, minlength=len(total))
        held = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(seeds[held].view(np.int64)), pa.array(total[held])], names=["seed", "n"])

    counts = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in counts.collect()}


def prepared(docs: DataFrame, items: DataFrame, part_words: int) -> Iterator[Items]:
    common.small_batches(docs.sparkSession)
    for part in parts(items, part_words):
        if len(part.seeds):
            yield part.rarest(document_counts(docs, part))


def contaminated(docs: DataFrame, items: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, item_id, score, similarity (score by item's words), first_word and end_word of the
    text's stretch for each leak of an item (item_id, text) into a document (doc_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id long, item_id {kind}, score long, similarity double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for part in prepared(docs, items, part_words):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            p = sent.value
            lengths = np.diff(p.border)
            for batch in common.slices(batches, limit=SLICE):
                found = list(p.leaks(batch.column(1)))
                if found:
                    ids = batch.column(0).take(pa.array([f[0] for f in found]))
                    columns = [pa.array([p.names[f[1]] for f in found], arrow_kind), [f[2] for f in found],
                               [f[2] / float(lengths[f[1]]) for f in found], [f[3] for f in found], [f[4] for f in found]]
                    yield pa.RecordBatch.from_arrays(
                        [ids, *map(pa.array, columns)],
                        names=["doc_id", "item_id", "score", "similarity", "first_word", "end_word"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of docs that no test item leaks into."""
    text = docs.columns.index("text")
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns' names
    for part in prepared(docs, items, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, text=text, limit=SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in sent.value.leaks(batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.toDF(*docs.columns)
