"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: ``share`` of all words dealt by weight, no source
above ``most`` times its own size, what a capped source can't take dealt among the others. The
targets have the form min(most * size, level * weight); the level is found with running sums over
the sources in the order in which they reach their caps.

A document's expected copies are its source's target over its size, the same for all documents of
the source. The documents of a source are put in order, of short ones to long ones, and their
expected copies summed up; with one random offset per source, a document is emitted once for each
integer that its stretch of the running sum crosses. So a document has the expected copies rounded
down or up, and neighbours in size make up for each other.

Rows of the same id, text and source are counted first, so they are one stretch of the
sum, however many they are. No source is ordered in one task: a source is cut into cells (size
class, hash), as many as its counted rows need, and only a cell's different rows are numbered
together, by their hashes alone. The copies are then joined back to the rows; rows that
occur more than ``CELL_ROWS`` times are not joined: equal ones are counted where they lie and made
anew from one of them, in pieces.
Everything is native. Sources are ordered in one task, a row of some 60 bytes each.

Defined results: null text has size 0; null sources are one source, the last in order; a source
without words has target 0; rows with one doc_id (null too) are documents of their own; equal rows
share their stretch's copies, differing by one at most; ties of size are ordered by the rows' hashes
(two of 64 bits); other columns are carried or not read; an empty table gives an empty table. The
same rows give the same mix, however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.llm.common import word_count
from corpuspack.session import materialize

#: Size classes per doubling of the size, and different rows of a class's hashed cell (about).
CLASSES, CELL_ROWS = 4, 20_000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """key, size -> key, source_size, target. One row per source: the running sums over all
    sources see only these."""
    by_name = Window.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    # the first level that the source it was reckoned for doesn't stop below
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"),
                         F.struct(F.col("cap") / F.col("weight"), F.col("key"), F.col("level")))).over(everything)
    return levels.withColumn("first", first).select(
        "key", F.col("size").alias("source_size"),
        F.when(F.col("first").isNull(), F.col("cap")).otherwise(
            F.least("cap", F.col("first.level") * F.col("weight"))).alias("target"))


def unit(*columns: Column) -> Column:
    """A number in [0, 1) made of the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def row_hash(row: DataFrame, names: Sequence[str], seed: int) -> Column:
    """A hash of columns that tells NULLs in them apart."""
    values = []
    for name in names:
        kind = row.schema[name].dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        value = F.col(f"`{name}`")
        values += [value.isNull(), F.to_json(F.struct(value)) if nested else value]
    return F.xxhash64(F.lit(seed), *values)


def crossed(rate: Column, offset: Column, start: Column, rows: Column) -> Column:
    """Integers crossed by the stretch of the running sum that rows from a place on take; rounding
    gives no row more than its expected copies rounded up."""
    crossings = F.floor(rate * (start + rows) + offset) - F.floor(rate * start + offset)
    return F.greatest(F.lit(0), F.least(crossings, F.ceil(rate) * rows)).cast("long")


def dealt_copies(docs: DataFrame, carry: Sequence[str], weights: Sequence[float], share: float, most: float, seed: int,
                 cell_rows: int) -> DataFrame:
    """row (the carried columns), size, source_size, target, copies."""
    size = word_count(F.col("text"))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    base, ident = ["doc_id", "text", "source"], ["key", "h1", "h2"]
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), key.alias("key"), size.alias("size"),
        row_hash(docs, base, seed).alias("h1"), row_hash(docs, base, seed + 1).alias("h2"))
    # tells rows apart that differ in other columns only
    rest = placed.select("*", *[row_hash(placed, ["row"], seed + i).alias(f"r{i}") for i in (1, 2)])
    size_class = F.floor(CLASSES * F.log2(F.col("size") + 1)).cast("int")

    kinds = materialize(placed.groupBy(*ident).agg(
        F.count("*").alias("rows"), F.max("size").alias("size")), "mix-kinds").withColumn("class", size_class)
    counted = materialize(kinds.groupBy("key", "class").agg(
        F.count("*").alias("kinds"), F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words")), "mix-classes")
    goal = targets(counted.groupBy("key").agg(F.sum("words").alias("size")), weights, share, most)
    classes = counted.select("key", "class", F.ceil(F.col("kinds") / F.lit(cell_rows)).alias("cells"), (
        F.sum("n").over(Window.partitionBy("key").orderBy("class")) - F.col("n")).alias("class_before"))
    # one row per class and one per cell, written out so that they are planned by their real size
    plan = materialize(classes.join(goal, ["key"]).select(
        "key", "class", "cells", "class_before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        unit(F.col("key"), F.lit(seed)).alias("offset")), "mix-plan")
    dealt = kinds.join(plan, ["key", "class"]).withColumn("cell", F.pmod(F.col("h1"), F.col("cells")))
    cells = materialize(dealt.groupBy("key", "class", "cell").agg(F.sum("rows").alias("n")), "mix-cells")
    cells = cells.select("key", "class", "cell", (
        F.sum("n").over(Window.partitionBy("key", "class").orderBy("cell")) - F.col("n")).alias("cell_before"))

    earlier = Window.partitionBy("key", "class", "cell").orderBy("size", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("class_before") + F.col("cell_before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    taken = materialize(dealt.join(cells, ["key", "class", "cell"]).withColumn("start", start).select(
        *ident, "rows", "size", "source_size", "target",
        crossed(F.col("rate"), F.col("offset"), F.col("start"), F.col("rows")).alias("total"),
    ), "mix-taken")
    # what occurs more than once, written out so that it is joined by its real size
    some = materialize(taken.where(F.col("rows").between(2, cell_rows)), "mix-repeats")
    many = materialize(taken.where(F.col("rows") > cell_rows), "mix-often")
    # copies are joined by the hashes alone: the words aren't counted again
    placed, rest = placed.drop("size"), rest.drop("size")

    # the first ones of the total's equal rows have one copy more
    def share_out(at: Column) -> Column:
        return (F.floor(F.col("total") / F.col("rows")) + (at < F.pmod("total", "rows")).cast("int")).cast("int").alias("copies")

    found = ["row", "size", "source_size", "target"]
    alone = placed.join(many.select(*ident), ident, "left_anti").join(taken, ident).where("rows = 1")
    few = rest.join(many.select(*ident), ident, "left_anti").join(some, ident)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy(*ident).orderBy("r1", "r2")) - 1)
    often = materialize(rest.join(many, ident).groupBy(*ident, "rows", "size", "source_size", "target", "total", "r1", "r2").agg(
        F.count("*").alias("k"), F.first("row").alias("row")).withColumn(
        "part", F.pmod("r1", F.ceil(F.col("rows") / F.lit(cell_rows)))), "mix-often-rows")
    parts = often.groupBy(*ident, "part").agg(F.sum("k").alias("n"))
    parts = parts.select(*ident, "part", (F.sum("n").over(Window.partitionBy(*ident).orderBy("part")) - F.col("n")).alias("part_before"))
    before = F.col("part_before") + F.sum("k").over(Window.partitionBy(*ident, "part").orderBy("r1", "r2")) - F.col("k")
    pieces = often.join(parts, [*ident, "part"]).withColumn("before", before).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(cell_rows).cast("long"))))
    ats = F.transform(F.sequence(F.col("piece"), F.least(F.col("piece") + cell_rows, F.col("k")) - 1), lambda x: x + F.col("before"))
    anew = pieces.repartition(F.col("r1"), F.col("piece")).withColumn("at", F.explode(ats))
    return alone.select(*found, F.col("total").cast("int").alias("copies")).unionByName(
        few.select(*found, share_out(F.col("at")))).unionByName(anew.select(*found, share_out(F.col("at"))))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
        carry: Sequence[str] = ("doc_id",), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Columns ``carry`` of docs (doc_id, text, source) and size, source_size, target, copies."""
    return dealt_copies(docs, carry, weights, share, most, seed, cell_rows).select("row.*", "size", "source_size", "target", "copies")


def emit(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
         cell_rows: int = CELL_ROWS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it has copies."""
    dealt = dealt_copies(docs, docs.columns, weights, share, most, seed, cell_rows)
    return dealt.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
