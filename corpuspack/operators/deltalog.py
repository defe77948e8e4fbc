"""A keyed table kept as a base and a log of changes, for state that grows with changes only.

Each version is one small table of the keys it sets or removes; after ``keep`` of them the table is
written out as a new base. A version is written under its number, so a step that runs again replaces
what it wrote, and reads what was there before it. Only tables written to the end count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions under a folder that were written to the end, in order."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(jvm.Path(p, "_SUCCESS")))


class DeltaLog:
    """``schema`` has the columns of the table, ``keys`` are those that tell its rows apart (NULL is a key)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, keep: int = 20):
        self.spark, self.folder, self.keys, self.schema, self.keep = spark, folder.rstrip("/"), keys, schema, keep

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v{version + 1:012d}"  # the first version is -1

    def _versions(self, kind: str, before: int | None) -> list[int]:
        found = [v - 1 for v in complete_versions(self.spark, f"{self.folder}/{kind}")]
        return [v for v in found if before is None or v < before]

    def last(self) -> int | None:
        """The latest version, None before the first."""
        return max(self._versions("base", None) + self._versions("delta", None), default=None)

    def start(self, rows: DataFrame, version: int = -1) -> None:
        """Write the whole table as a version."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(self._path("base", version))

    def append(self, version: int, rows: DataFrame, compact: bool = True) -> None:
        """Write a version: rows of the table with a flag ``gone`` (only the keys count where it is set).
        Each key once."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names, "gone").write.mode("overwrite").parquet(self._path("delta", version))
        bases = self._versions("base", None)
        if compact and len([v for v in self._versions("delta", None) if v > max(bases, default=-2)]) >= self.keep:
            self.start(self.current(), version)

    def _same(self) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}"))
        return same

    def current(self, before: int | None = None) -> DataFrame:
        """The table after the latest version, or after the last one before a version."""
        base = max(self._versions("base", before), default=None)
        if base is None:
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.read.schema(self.schema).parquet(self._path("base", base))
        paths = [self._path("delta", v) for v in self._versions("delta", before) if v > base]
        if not paths:
            return table
        # the folder's number is the version; the base is only joined with the keys that changed since
        deltas = self.spark.read.schema(f"{self.schema}, gone boolean").parquet(*paths)
        deltas = deltas.withColumn("_v", F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d{12})/[^/]*$", 1))
        latest = deltas.withColumn("_rank", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_v")))).where("_rank = 1")
        latest = latest.drop("_v", "_rank")
        kept = table.alias("b").join(latest.select(*self.keys).alias("d"), self._same(), "left_anti")
        return kept.unionByName(latest.where("not gone").drop("gone"))
