"""Shared pieces of the training-data operators: words, word hashes and shingle sets."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array (native); null text: no words."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def word_count(text: Column) -> Column:
    """Number of words (native, long); null text: 0."""
    return F.size(words(text)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (every input bit reaches every output bit), modulo 2^64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    """A random-looking 64-bit value per byte, A-Z as a-z; separators have 0."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    values = mix((lower + np.uint64(1)) * _GOLD)
    values[[ord(c) for c in SEPARATORS]] = 0
    return values


_VALUES = _byte_values()
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[ord(c) for c in SEPARATORS]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = 1 << 17
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse), kept between calls."""
    have = _POWERS[which]
    if len(have) < n:
        grown = np.full(max(n, 1 << 16), np.uint64(_BASE if which == "up" else _INVERSE))
        grown[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(grown)
    return have[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word in a UTF-8 buffer; letters A-Z count as a-z.

    A word's hash is a polynomial in its bytes, cut out of one running sum over the buffer.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = _IS_SEP[data]
    edge = np.diff(np.concatenate(([1], sep.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):  # so many bytes at a time that they stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(end, start[first] + _BYTES, "right")))
        at, until = start[first:last] - start[first], end[first:last] - start[first]
        n = int(until[-1])
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data[start[first]:start[first] + n]] * _powers("up", n), out=running[1:])
        out[first:last] = (running[until] - running[at]) * _powers("down", n)[at]
        first = last
    return mix(out + (end - start).astype(np.uint64) * _GOLD), start, end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one space before each text, and where each text begins
    (one entry more than rows); null: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    spaced = np.insert(data, at[:-1], 32) if len(column) else data
    return spaced, at + np.arange(len(at))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``limit`` bytes of the text column each (a longer text alone), to
    bound memory; none is empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:] if len(column) else np.zeros(1, np.int64)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets[:len(column) + 1], offsets[first] + limit, "right")) - 1
            last = min(max(first + 1, last), len(column))
            yield batch.slice(first, last - first)
            first = last
    release()


#: Rows sent to a Python worker at once: texts are large, and two copies are held on either side.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in small batches, unless the session says otherwise."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":  # Spark's own value
        spark.conf.set(setting, str(ROWS_PER_BATCH))


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text, end to end, and the border of each set.

    Fewer than n words: the whole sequence is one shingle; no word: an empty set.
    """
    data, at = text_bytes(column)
    hashes, start, _ = word_hashes(data)
    first = np.searchsorted(start, at)  # index of each text's first word
    counts = np.diff(first)
    width = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text_of = np.repeat(np.arange(len(counts)), width)
    begin = np.arange(len(text_of)) - np.repeat(np.cumsum(width) - width, width) + first[text_of]
    size = np.minimum(counts, n)[text_of]
    total = np.zeros(len(text_of), np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        total = np.where(k < size, mix(total + padded[begin + k] * np.uint64(2 * k + 1) + _GOLD), total)
    order = np.lexsort((total, text_of)) if len(total) else np.zeros(0, np.int64)
    total, text_of = total[order], text_of[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text_of[1:] != text_of[:-1])
    total, text_of = total[new], text_of[new]
    return total, np.searchsorted(text_of, np.arange(len(counts) + 1))
