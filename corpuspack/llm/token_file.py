"""Token ids as binary blocks: one id array and Elias-Fano coded document boundaries.

A block holds the ids of successive documents end to end and, instead of a table of 64-bit
offsets, the documents' starts in Elias-Fano form: of each start the low bits as they are, the
high bits as ones in a bit row (start i sets bit high(i) + i), in all about 2 + log2(ids per
document) bits per document. The i-th start is found with a select structure: the bit position
of every 64th one. Document ids are coded the same way.

Block layout (little endian): header, ids, then for starts and for document ids: low bits, high
bits, select samples. A file set is a Parquet table with one row per block (part, number, bytes)
written by Spark's commit protocol, so lost executors and retried tasks leave no stray file; the
bytes of a row are the block and need nothing else to be read.

Documents are in ascending doc_id order over parts, blocks and rows: null ids first, repeated ids
by text. Null or empty text: the end id alone. Other columns are not read. An empty table gives
no block.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspack.llm import common, tokens
from corpuspack.session import scratch_path

MAGIC = b"EFID"
#: magic, version, bytes of an id, low bits of starts and of document ids, documents, of them
#: without id, ids, first document id
HEADER = struct.Struct("<4sBBBBQQQq")
SAMPLE = 64
#: Text of a block's documents, in bytes (a longer document has a block of its own).
BLOCK_BYTES = 2 << 20


@dataclass
class EliasFano:
    """A rising row of non-negative integers."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def width(count: int, largest: int) -> int:
        return max(0, ((largest + 1) // max(1, count)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, largest = len(values), int(values[-1]) if len(values) else 0
        w = cls.width(n, largest)
        bits = ((values[:, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(w)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, w, np.packbits(bits.reshape(-1), bitorder="little"), np.packbits(high, bitorder="little"),
                   ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", len(self.high), len(self.samples)) + b"".join(
            x.tobytes() for x in (self.low, self.high, self.samples))

    @classmethod
    def from_bytes(cls, data: memoryview, count: int, low_bits: int) -> tuple[EliasFano, int]:
        n_high, n_samples = struct.unpack_from("<QQ", data)
        n_low = (count * low_bits + 7) // 8
        at = [16, 16 + n_low, 16 + n_low + n_high, 16 + n_low + n_high + 4 * n_samples]
        part = [np.frombuffer(data[a:b], np.uint8) for a, b in zip(at, at[1:], strict=False)]
        return cls(count, low_bits, part[0], part[1], part[2].view("<u4")), at[-1]

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.count].astype(np.uint64)
        high = (ones - np.arange(self.count, dtype=np.uint64)) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[:self.count * self.low_bits].reshape(self.count, self.low_bits)
        return high + (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the bits up to the i-th one."""
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        seen = -int(np.unpackbits(self.high[byte:byte + 1], bitorder="little")[:at % 8].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + SAMPLE], bitorder="little"))
            if seen + len(ones) > need:
                one = byte * 8 + int(ones[need - seen])
                break
            seen, byte = seen + len(ones), byte + SAMPLE
        first, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (int(self.low[(first + k) // 8]) >> ((first + k) % 8) & 1) << k
        return ((one - i) << self.low_bits) | low


@dataclass
class Block:
    """A block read back: ids, starts (one more than documents) and document ids."""

    ids: np.ndarray
    starts: EliasFano
    docs: EliasFano
    first_doc: int
    without_id: int

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, without decoding the others."""
        return self.ids[self.starts.select(i):self.starts.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.without_id + [int(x) + self.first_doc for x in self.docs.all()]


def write_block(ids: np.ndarray, counts: np.ndarray, docs: list[int | None], id_bytes: int) -> bytes:
    """Documents (null ids first, then rising) with their numbers of ids as one block."""
    known = [d for d in docs if d is not None]
    first = known[0] if known else 0
    starts = EliasFano.encode(np.concatenate(([0], np.cumsum(counts, dtype=np.uint64))).astype(np.uint64))
    names = EliasFano.encode(np.array([d - first for d in known], np.uint64))
    head = HEADER.pack(MAGIC, 1, id_bytes, starts.low_bits, names.low_bits, len(docs), len(docs) - len(known), len(ids), first)
    return head + ids.astype(f"<u{id_bytes}").tobytes() + starts.to_bytes() + names.to_bytes()


def read_block(data: bytes) -> Block:
    magic, version, width, low_starts, low_docs, n_docs, without, n_ids, first = HEADER.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    rest = memoryview(data)[HEADER.size:]
    ids = np.frombuffer(rest[:n_ids * width], f"<u{width}")
    starts, used = EliasFano.from_bytes(rest[n_ids * width:], n_docs + 1, low_starts)
    docs, _ = EliasFano.from_bytes(rest[n_ids * width + used:], n_docs - without, low_docs)
    return Block(ids, starts, docs, first, without)


#: Pieces that are one word and ASCII marks (no apostrophe) after it: words and marks are encoded apart,
#: case is dropped.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Pieces, and words, that each worker keeps the ids of, at about 30 bytes each.
KEPT = 1_500_000


class Table:
    """Ids of pieces by the pieces' hashes: rising hashes, and where each piece's ids lie."""

    def __init__(self, kind: str):
        self.kind = kind
        self.hashes, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, kind)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, made: list[bytes], needed: np.ndarray) -> None:
        """New entries; the hashes rise and have no entry yet. A full table keeps only the
        entries ``needed`` now."""
        if len(self.hashes) + len(hashes) > KEPT:
            part = [self.ids[b:b + n] for b, n in zip(self.begin[needed], self.count[needed], strict=True)]
            self.hashes, self.count = self.hashes[needed], self.count[needed]
            self.begin = np.cumsum(self.count, dtype=np.int32) - self.count
            self.ids = np.concatenate([np.zeros(0, self.kind), *part])
        count = np.fromiter(map(len, made), np.int32, len(made)) // np.dtype(self.kind).itemsize
        begin = np.int32(len(self.ids)) + np.cumsum(count, dtype=np.int32) - count
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (np.insert(old, at, new) for old, new in (
            (self.hashes, hashes), (self.begin, begin), (self.count, count)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(made), self.kind)))

    def complete(self, hashes: np.ndarray, learn) -> np.ndarray:
        """Entries of different rising hashes; ``learn`` makes the ids of those (by index) that
        are new."""
        place = self.places(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            self.add(hashes[new], learn(new.tolist()), place[place >= 0])
            place = self.places(hashes)
        return place


class Encoder:
    """Ids of texts under one vocabulary. The pieces between ASCII white space are encoded on
    their own: white space, lower case and composition act within a piece, so a cut at white space
    changes no id. Pieces are told apart by 64-bit hashes (one of a table's pieces and a
    new one meet with a chance of 8e-14), each different one is looked up or encoded once,
    and the ids are laid out in one array. Hashes and pieces fold case, but for pieces that hold an
    added token of the vocabulary in any case: the library may match those in the raw text only."""

    def __init__(self, vocabulary: str):
        self.tokenizer = tokens.load(vocabulary)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.id_bytes}"
        self.pieces, self.words = Table(self.kind), Table(self.kind)
        added = {t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile(b"|".join(map(re.escape, sorted(added - {b""}, key=len, reverse=True))) or b"(?!)")

    def encode(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in made]

    def encode_words(self, words: list[str], at_once: int = 500) -> list[bytes]:
        """As ``encode``, for words and marks that are one pre-token each: many in one text."""
        out = []
        for i in range(0, len(words), at_once):
            part = words[i:i + at_once]
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            word = np.array(made.word_ids, np.int64)
            if not len(word) or word[-1] != len(part) - 1:  # some word is more than one
                out += self.encode(part)
                continue
            raw = np.array(made.ids, self.kind).tobytes()
            cut = (np.searchsorted(word, np.arange(len(part) + 1)) * self.id_bytes).tolist()
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def known(self, words: list[str]) -> dict[str, bytes]:
        """The ids of lower-cased words or marks, of those not met before by encoding them."""
        hashes, _, _ = common.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
        different, first = np.unique(hashes, return_index=True)
        t = self.words
        place = t.complete(different, lambda new: self.encode_words([words[first[k]] for k in new]))
        raw, size = t.ids.tobytes(), self.id_bytes
        begin, end = (t.begin[place] * size).tolist(), ((t.begin + t.count)[place] * size).tolist()
        return {words[f]: raw[b:e] for f, b, e in zip(first.tolist(), begin, end, strict=True)}

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces (ASCII letters lower-cased, but for those that hold an added token)."""
        texts = [p.decode() for p in pieces]
        plain = [m and (m[1].lower(), m[2]) for m in map(_PLAIN.fullmatch, texts)]
        words = {w for pair in plain if pair for w in pair}
        words.discard("")
        ids = self.known(list(words)) | {"": b""}
        other = iter(self.encode([t for t, pair in zip(texts, plain, strict=True) if not pair]))
        return [ids[pair[0]] + ids[pair[1]] if pair else next(other) for pair in plain]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        data, at = common.text_bytes(column)
        hashes, start, end = common.word_hashes(data)
        as_written, raw = data.tobytes(), data.tobytes().lower()  # ASCII letters
        marked = {int(np.searchsorted(start, m.start(), "right")) - 1 for m in self.added.finditer(raw)}
        for k in marked:
            digest = hashlib.blake2b(as_written[start[k]:end[k]], digest_size=8).digest()
            hashes[k] = int.from_bytes(digest, "little")
        which, found = pd.factorize(hashes)  # cheaper than sorting all occurrences
        first = np.empty(len(found), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        order = np.argsort(found)
        t = self.pieces
        place = np.empty(len(found), np.int64)
        place[order] = t.complete(found[order], lambda new: self.learn(
            [(as_written if k in marked else raw)[start[k]:end[k]] for k in first[order[new]].tolist()]))
        begin, count = t.begin[place][which], t.count[place][which]
        before = np.zeros(len(count) + 1, np.int32)  # of one slice, as the table: far below 2^31 ids
        np.cumsum(count, out=before[1:])
        at_id = np.repeat(begin - before[:-1], count)
        at_id += np.arange(len(at_id), dtype=np.int32)
        ids = t.ids[at_id]
        return ids, np.diff(before[np.searchsorted(start, at)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary, kept between tasks (a function that is sent to a
    task carries copies of the values it uses, this module's own is not copied)."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2,
                 block_bytes: int = BLOCK_BYTES) -> None:
    """Write the token blocks of ``docs`` (doc_id, text) to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for number, batch in enumerate(common.slices(batches, limit=block_bytes)):
            ids, counts = e.texts(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            data = write_block(ids, counts + 1, batch.column(0).to_pylist(), e.id_bytes)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
                "n_docs": pa.array([batch.num_rows], pa.int64()), "before": pa.array([before], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
            before += len(ids)

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, block int, n_docs long, before long, n_ids long, data binary").write.option(
        "compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) of each document in the files at ``path``."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row per range partition: bounded by the number of partitions that wrote the files
    begins = totals.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = read_block(data.as_buffer())
                at = b.starts.all().astype(np.int64)
                wide = np.ascontiguousarray(b.ids.astype("<u4"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(b.doc_ids(), pa.int64()),
                    "start": pa.array(at[:-1] + begin, pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(wide[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.int64())})

    placed = blocks.join(F.broadcast(begins), "part").select((F.col("begin") + F.col("before")).alias("begin"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` (to a new place in the shared folder unless one is
    named) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path)
