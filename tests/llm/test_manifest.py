"""Merkle manifest against plain trees, built level by level in lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpuspack.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    """(the sibling's digest or None, whether it is on the right) of each level."""
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i % 2 == 0
        i //= 2


def plain_audit(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in trees.values():
        x.sort(key=lambda t: t[:3])
    levels = {lang: plain_levels([x[2] for x in trees[lang]]) for lang in langs}
    over = plain_levels([levels[lang][-1][0] for lang in langs])
    for rank, lang in enumerate(langs):
        for i, (_, _, leaf, (doc_id, text, _, source, n)) in enumerate(trees[lang]):
            path = [*plain_path(levels[lang], i), *plain_path(over, rank)]
            change = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            node = plain_leaf(doc_id, text, lang, source, n + 1) if change else leaf
            for other, right in path:
                node = h(node) if other is None else h(node, other) if right else h(other, node)
            yield (doc_id, leaf, levels[lang][-1][0], over[-1][0], h(*[x for x, _ in path if x]), node, node == over[-1][0])


def check(frame, rows):
    got = sorted(map(repr, map(tuple, manifest.audit(frame).collect())))
    assert got == sorted(map(repr, plain_audit(rows)))


@pytest.fixture(params=[1, 2, 10])
def bits(request, monkeypatch):
    monkeypatch.setattr(manifest, "BITS", request.param)


def test_against_plain_trees(documents, bits):
    sizes = {"en": 21, "de": 8, "fr": 1, None: 5, "ö": 2, "z": 16, "": 3}
    rows = [(1000 * k + i, f"text é {i}", lang, "s" if i % 3 else None, i if i % 4 else None)
            for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    check(documents(rows), rows)


def test_one_tree_and_one_leaf(documents, bits):
    for n in (1, 2, 3, 4, 5, 17):
        rows = [(i, "t", "en", "a", 1) for i in range(n)]
        check(documents(rows), rows)


def test_odd_rows(odd, clashing, empty, spark):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check(odd, rows)
    check(clashing, rows)
    assert manifest.audit(empty).collect() == []


def test_largest_number_and_other_types(documents):
    top = 2**63 - 1
    rows = [(i, "t", "en", "a", top) for i in range(40)]
    check(documents(rows), rows)


def test_equal_ids_are_ordered_by_leaf(documents):
    rows = [(7, f"text {i}", "en", "a", i) for i in range(9)] + [(7, "text 1", "en", "a", 1)] * 2
    check(documents(rows), rows)


def test_paths_lead_to_the_root(documents):
    docs = documents([(i, f"t{i}", "en" if i % 2 else "de", "a", i) for i in range(30)])
    told = manifest.manifest(docs)
    folded = told.select("root", manifest.fold(F.col("leaf"), F.col("path")).alias("got"), "tampered").collect()
    assert len(folded) == 30 and all(r.root == r.got and r.tampered is None for r in folded)
    wrong = told.select("root", manifest.fold(F.reverse("leaf"), F.col("path")).alias("got")).collect()
    assert all(r.root != r.got for r in wrong)
