"""Orders: depth-first tree order, sibling ranks and positions inside ordered groups.

``positions`` gives each row its 0-based position (and running byte offset) inside its
group without putting a group into one task: rows are range-partitioned on
``(group, key)`` so a huge group spreads over many ranges; each range numbers its rows
locally in one streaming pass over Arrow batches; the per-(range, group) totals - at most
ranges + groups rows - are turned into start offsets and joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspack.functions import paths as P
from corpuspack.session import materialize


def tree_order(nodes: DataFrame) -> DataFrame:
    """Nodes with their depth-first order key ``okey`` (sort by it for the tree order)."""
    isdir = F.col("is_dir") if "is_dir" in nodes.columns else F.lit(False)
    return nodes.withColumn("okey", P.tree_key(F.col("path"), isdir))


def _local_positions(group: str, key: str, size: str | None):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, last_group, carry_n, carry_off = False, None, 0, 0  # whether any row came before
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            g = b.column(group)
            sizes = (
                b.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if size else np.zeros(n, dtype=np.int64)
            )
            starts = np.zeros(n, dtype=bool)
            starts[0] = True
            if n > 1:
                one, two = g.slice(1), g.slice(0, n - 1)
                both_null = pc.and_(pc.is_null(one), pc.is_null(two))  # NULL is a group like others
                neq = pc.if_else(both_null, False, pc.not_equal(one, two).fill_null(True))
                starts[1:] = neq.to_numpy(zero_copy_only=False)
            first_g = g[0].as_py()
            continues = before and first_g == last_group
            idx = np.arange(n, dtype=np.int64)
            run_start = np.maximum.accumulate(np.where(starts, idx, 0))
            local = idx - run_start
            csum = np.cumsum(sizes) - sizes  # exclusive prefix within batch
            off = csum - csum[run_start]
            if continues:
                first_run = run_start == 0
                local = np.where(first_run, local + carry_n, local)
                off = np.where(first_run, off + carry_off, off)
            carry_n = int(local[-1]) + 1
            carry_off = int(off[-1] + sizes[-1])
            before, last_group = True, g[n - 1].as_py()
            yield b.append_column("_range", pa.array(np.full(n, part, dtype=np.int32))) \
                .append_column("_lseq", pa.array(local)).append_column("_loff", pa.array(off))

    return run


def positions(df: DataFrame, group: str, key: str, size: str | None = None,
              num_ranges: int | None = None) -> DataFrame:
    """Add ``seq`` (0-based position by ``key`` inside ``group``) and, when ``size`` is
    given, ``offset`` (sum of ``size`` over the earlier rows of the group)."""
    ranged = df.repartitionByRange(num_ranges, group, key) if num_ranges else df.repartitionByRange(group, key)
    ranged = ranged.sortWithinPartitions(group, key)
    schema = T.StructType(
        list(df.schema.fields)
        + [T.StructField("_range", T.IntegerType()), T.StructField("_lseq", T.LongType()),
           T.StructField("_loff", T.LongType())]
    )
    # a written table pins the range ids: totals and the join-back read the same rows
    local = materialize(ranged.mapInArrow(_local_positions(group, key, size), schema), "positions")
    totals = local.groupBy("_range", group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(size) if size else F.lit(0)).cast("bigint").alias("_sz")
    )
    w = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "_range", group,
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_seq0"),
        F.coalesce(F.sum("_sz").over(w), F.lit(0)).alias("_off0"),
    )
    base = base.withColumnsRenamed({"_range": "_range0", group: "_group0"})
    same = (F.col("_range") == F.col("_range0")) & F.col(group).eqNullSafe(F.col("_group0"))
    out = local.join(base, same).drop("_range0", "_group0").withColumn("seq", F.col("_seq0") + F.col("_lseq"))
    if size:
        out = out.withColumn("offset", F.col("_off0") + F.col("_loff"))
    return out.drop("_range", "_lseq", "_loff", "_seq0", "_off0")


def sibling_rank(nodes: DataFrame) -> DataFrame:
    """1-based rank of each node among its siblings: directories first, then the
    case-folded name, then the name."""
    df = nodes.select(
        "path", "is_dir", P.parent_dir("path").alias("parent"), P.base_name("path").alias("name")
    )
    df = df.withColumn(
        "_k", F.concat(F.when(F.col("is_dir"), "0").otherwise("1"), F.hex(F.lower("name")), F.lit(" "), F.hex("name"))
    )
    ranked = positions(df, "parent", "_k")
    return ranked.select("path", "parent", "name", "is_dir", (F.col("seq") + 1).alias("sibling_rank"))
