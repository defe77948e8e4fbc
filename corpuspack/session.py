"""Session helpers: a local session for tests and the shared folder for written state."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpuspack",
                  more: dict[str, str] | None = None) -> SparkSession:
    """A local session configured like the cluster one (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.config(map=more or {}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a local master,
    where one machine is all there is, gets a fresh scratch folder if the session names none;
    on a cluster that is an error, as each node would write to a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="corpuspack-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def ship(spark: SparkSession) -> None:
    """Give executors on other machines this package, if it runs from a folder there is no
    installation of (a local master's workers read the folder itself)."""
    import shutil

    import corpuspack

    home = os.path.dirname(os.path.dirname(os.path.abspath(corpuspack.__file__)))
    if os.path.basename(home) in ("site-packages", "dist-packages") or re.fullmatch(
            r"local(\[.*\])?", spark.sparkContext.master or ""):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="corpuspack-"), "corpuspack"), "zip", home, "corpuspack")
    spark.sparkContext.addPyFile(made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Redistribute an under-split input before CPU-heavy per-row work.

    Only when the input has fewer partitions than the session's parallelism (e.g. one
    large row group read locally); a big table already has many splits and is returned
    as is, so no shuffle is added at scale. Hash on ``key`` keeps retries deterministic.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as a parquet table in a new folder under the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: computed
    once, lineage cut, and it survives executor loss (unlike a cache)."""
    return df.sparkSession.read.parquet(write_table(df, name))


def posix_path(uri: str) -> str:
    """Local path of a ``file:`` URI (or a plain path); other schemes cannot be opened with
    os-level IO and are refused."""
    if uri.startswith("file://"):
        return uri[len("file://"):] or "/"
    if uri.startswith("file:"):
        return uri[len("file:"):]
    if "://" in uri:
        raise ValueError(f"{uri!r} is not a POSIX path every executor can open")
    return uri
