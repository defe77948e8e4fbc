"""Token files: round trips, Elias-Fano select, whole tables against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from corpuspack.llm import token_file as T  # noqa: E402
from corpuspack.llm import tokens  # noqa: E402


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(0, 5000, 7)), [0, 1, 1, 1_000_000, 1 << 40]])
def test_elias_fano_round_trip_and_select(values):
    made = T.EliasFano.encode(np.array(values, np.uint64))
    back, used = T.EliasFano.from_bytes(memoryview(made.to_bytes() + b"rest"), len(values), made.low_bits)
    assert used == len(made.to_bytes())
    assert back.all().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values


def test_starts_take_little_space():
    starts = np.cumsum(np.random.default_rng(1).integers(100, 900, 100_000)).astype(np.uint64)
    assert 8 * len(T.EliasFano.encode(starts).to_bytes()) / len(starts) < 13  # 64 as a table


def test_block_round_trip():
    ids, counts, docs = np.arange(100), np.array([10, 0, 60, 30]), [None, -4, 7, 7]
    block = T.read_block(T.write_block(ids, counts, docs, 2))
    assert block.doc_ids() == docs and block.starts.all().tolist() == [0, 10, 10, 70, 100]
    assert [block.document(i).tolist() for i in range(4)] == [
        list(range(10)), [], list(range(10, 70)), list(range(70, 100))]
    with pytest.raises(ValueError):
        T.read_block(b"no block" * 20)


def test_pieces_give_the_librarys_ids():
    rng, parts = random.Random(2), [*"ab cdE'  \n\t.!?1 23éßñ日本ÀÈ\x1c\x85\xa0é ", "'ll", "'RE", " the", "<|endoftext|>", "$$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encoder = T.Encoder("word_bpe_49k.json")
    for _ in range(2):  # the second time from the memo
        ids, counts = encoder.texts(pa.array(texts))
        at = np.cumsum(counts) - counts
        for text, a, n in zip(texts, at, counts, strict=True):
            assert ids[a:a + n].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_full_tables_forget_without_changing_ids(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 20)
    encoder, text = T.Encoder("word_bpe_49k.json"), " ".join(f"ab{chr(97 + i % 26)}{chr(97 + i % 7)}x" for i in range(200))
    for part in (text, text[::-1], text):
        assert encoder.texts(pa.array([part]))[0].tolist() == encoder.tokenizer.encode(part, add_special_tokens=False).ids


def expected(rows, end=2):
    library, start = tokens.load("word_bpe_49k.json"), 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_of_odd_rows(odd, empty, clashing, documents):
    order = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0]))
    want = list(expected(order))
    for table in (odd, clashing):
        got = sorted((tuple(r) for r in T.token_file(table).collect()), key=lambda r: r[1])
        assert got == want
    assert T.token_file(empty).count() == 0


def test_many_blocks_and_parts(documents, spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three,", "Four"]) for _ in range(rng.randint(0, 90))), None, None, 0)
            for i in rng.sample(range(10_000), 500)]
    T.write_tokens(documents(rows, parts=7), str(tmp_path / "t"), block_bytes=2000)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 20
    got = sorted((tuple(r) for r in T.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert got == list(expected(sorted((r[0], r[1]) for r in rows)))


def test_added_tokens_in_any_case_give_the_librarys_ids():
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|EndOfText|>x <|endoftext|>x", "x<|StartOfText|>Y <|startoftext|>", "<|endofTEXT|><|endoftext|>",
             "THE<|endoftext|> the<|endoftext|> The<|ENDOFTEXT|>"]
    encoder = T.Encoder("word_bpe_49k.json")
    for column in (texts, texts[::-1], texts):
        ids, counts = encoder.texts(pa.array(column))
        at = np.cumsum(counts) - counts
        for text, a, n in zip(column, at, counts, strict=True):
            assert ids[a:a + n].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
