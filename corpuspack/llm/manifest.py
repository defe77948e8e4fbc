"""Merkle manifest of a table of documents, with a proof of membership for every document.

A document's leaf is the hash of its fields. Each language is a tree over its leaves in doc_id
order; the languages' roots are the leaves of one more tree, whose root is the table's.

The nodes of a tree are cut into aligned blocks of ``1 << BITS``. A block is one row that keeps each
of its levels as one string of hexadecimal digests end to end: a level's parents are the hashes of
its substrings of two digests, a node's siblings are the substrings that flank the nodes above it.
The blocks' last nodes are the nodes of the next round, until a tree is one block; a round has
``1 << BITS`` times fewer rows. On the way down a block gets the siblings above it and hands each
of its nodes its own ones followed by these, so that only rows of blocks are joined, never one
per document and level. A single node at the end of a level is hashed alone.

Blocks at a tree's end know how often to hash without a count of the tree: a block that isn't the
first goes all the way, and a first one that is the only one goes to its single node (a first one
that isn't is full, which is the same number of levels).

Defined results: null fields have a mark of their own, so a null and an empty text differ; null
languages are a tree, and null ids come first in theirs; equal ids are ordered by their leaves,
repeated rows are leaves of their own; very long texts are hashed in the task that reads them;
other columns are not read; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspack.operators.ordering import positions
from corpuspack.session import materialize

#: Levels of a block: it has two to this power nodes at most (64 KB of digests in its lowest level).
BITS = 10
DIGEST = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes and its characters, or the mark of a null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a document's fields, some of them changed."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree (the language), leaf; with ``tampered`` (a condition on documents) also the leaf
    such a document has with one more in n_chars (null n_chars stay), null for others."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(n_chars=more))
    return docs.select(*FIELDS).select(
        "doc_id", F.col("lang").cast("string").alias("tree"), leaf().alias("leaf"), other.alias("tampered"))


def parents(level: Column) -> Column:
    """The level above a level: the hash of every two digests, and of a last one alone."""
    last = F.shiftright(F.octet_length(level) - 1, 7)
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(
        F.substring(level, i * (2 * DIGEST) + 1, F.lit(2 * DIGEST)), 256)), "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, loads, levels (each a binary string of hexadecimal text) of nodes
    ``(tree, pos, node, load)`` with the positions 0, 1, ... in each tree."""
    member = F.struct("pos", "node", "load")
    rows = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    n = F.size("m")
    depth = F.when(F.col("block") > 0, BITS).when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    lowest = F.array_join(F.transform("m", lambda x: x["node"]), "").cast("binary")
    levels = F.aggregate(steps, F.array(lowest), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))
    return rows.select("tree", "block", F.transform("m", lambda x: x["load"]).alias("loads"), levels.alias("levels"))


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each round, from the leaves up to the round in which every tree is one block."""
    rounds = [materialize(blocks(nodes), f"{name}-0")]
    while not rounds[-1].where("block > 0").isEmpty():
        rounds.append(materialize(blocks(tops(rounds[-1]).withColumnRenamed("block", "pos")), f"{name}-{len(rounds)}"))
    return rounds


def tops(of: DataFrame) -> DataFrame:
    """tree, block, node, load (nothing): the last node of each block."""
    return of.select("tree", "block", F.element_at("levels", -1).cast("string").alias("node"), F.lit(None).cast("string").alias("load"))


def siblings(j: Column, levels: Column) -> Column:
    """The sibling at each level on the way up from a block's node: ``l`` or ``r``, the side it is
    on, and its digest; an empty string where there is none."""

    def one(k: Column) -> Column:
        other = F.call_function("shiftright", j, k).bitwiseXOR(F.lit(1))
        level = F.get(levels, k)
        digest = F.substring(level, other * DIGEST + 1, F.lit(DIGEST)).cast("string")
        side = F.when(other.bitwiseAND(F.lit(1)) == 1, F.lit("r")).otherwise(F.lit("l"))
        return F.when(other * DIGEST < F.octet_length(level), F.concat(side, digest)).otherwise(F.lit(""))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), one)).otherwise(
        F.array().cast("array<string>"))


def members(of: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, load, path, subroot of the nodes of blocks; ``above(tree, block, path, subroot)``
    has the siblings above each block."""
    above = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("path").alias("_above"), "subroot")
    rows = of.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    each = F.transform("loads", lambda load, j: F.struct(
        (F.col("block") * (1 << BITS) + j).alias("pos"), load.alias("load"),
        F.concat(siblings(j, F.col("levels")), F.col("_above")).alias("path")))
    return rows.select("tree", "subroot", F.explode(each).alias("x")).select("tree", "subroot", "x.*")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, pos, load, path, subroot of the leaves; ``above`` is what :func:`members` takes, for
    the block that each tree ends in."""
    for of in reversed(rounds[1:]):
        above = members(of, above).withColumnRenamed("pos", "block")
    return members(rounds[0], above)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root, path of each row of docs.

    ``path`` has the siblings of each level from the leaf to the root (see :func:`siblings`):
    what :func:`fold` needs to get the root from the leaf.
    """
    rows = materialize(leaves(docs, tampered), "manifest-leaves")
    key = F.struct("doc_id", "leaf")
    ranked = positions(rows.withColumn("key", key), "tree", "key")
    load = F.struct("doc_id", "leaf", "tampered")
    rounds = climb(ranked.select("tree", F.col("seq").alias("pos"), F.col("leaf").alias("node"), load.alias("load")), "manifest")

    ends = tops(rounds[-1]).select(F.lit("").alias("all"), F.struct("tree").alias("key"), "tree", "node")
    heads = positions(ends, "all", "key")
    over = climb(heads.select(F.col("all").alias("tree"), F.col("seq").alias("pos"), "node", F.struct("tree", "node").alias("load")), "manifest-roots")
    root = tops(over[-1]).select("node").first()  # one row, or none of an empty table
    start = over[-1].select("tree", "block", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"))
    above = descend(over, start).select("load.tree", F.lit(0).cast("long").alias("block"), "path", F.col("load.node").alias("subroot"))
    found = descend(rounds, materialize(above, "manifest-above"))
    return found.select("load.doc_id", "load.leaf", "load.tampered", "subroot", F.lit(root.node if root else None).cast("string").alias("root"), "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node: Column, sibling: Column) -> Column:
        digest = F.substring(sibling, 2, DIGEST)
        left = F.when(F.startswith(sibling, F.lit("l")), digest).otherwise(F.lit(""))
        right = F.when(F.startswith(sibling, F.lit("r")), digest).otherwise(F.lit(""))
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(path, start, up)


def proof(path: Column) -> Column:
    """The hash of all siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, DIGEST)), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether each leaf, changed where 7 divides the id's check sum,
    still leads to the root."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = manifest(docs, changed)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return told.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
