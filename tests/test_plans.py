"""Plan shape: no Python in the text path, content pruned from selections, globs pushed down."""

from corpuspack.plans import catalog
from corpuspack.plans.fixtures import Tables
from tables import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pack_and_transforms_stay_in_jvm(spark):
    for name in ["bundle_stats", "transform_all", "strip_comments", "file_blocks", "visible", "dir_rollup"]:
        plan = _plan(catalog.REGISTRY[name](spark, SF001))
        assert "EvalPython" not in plan and "PythonUDF" not in plan, name


def test_selection_does_not_read_content(spark, tmp_dir):
    t = Tables(spark, SF001)
    path = f"{tmp_dir}/files"
    t.files.write.parquet(path)
    from corpuspack.operators import selection as S

    files = spark.read.parquet(path)
    plan = _plan(S.select_glob(S.visible_files(files, catalog.HIDE), ["*.py"]))
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln][0]
    assert "content" not in scan.split("ReadSchema")[1]
    assert "StringEndsWith(path,.py)" in scan  # the simple glob reached the parquet scan


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["bundle", "n_files", "n_lines", "n_chars", "kb"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_bundle_sink_keeps_order_for_the_writer(spark):
    """The frame handed to the partitioned text writer is ordered by bundle, so the writer
    adds no (unstable) sort of its own that could reorder the blocks of a bundle."""
    from pyspark.sql import Observation

    from corpuspack.operators import bundle as B

    files = spark.createDataFrame([("b", "b/x.py", "x\n")], "bundle string, path string, content string")
    frame = B.sink_frame(B.pack(files), observation=Observation("t"))
    order = frame._jdf.queryExecution().optimizedPlan().outputOrdering().toString()
    assert order.startswith("List(bundle") and "ASC" in order


def test_flagship_plan_shape(spark):
    """Per-bundle statistics: no join at all, and every exchange moves either the
    redistributed input or tiny per-bundle rows (partial aggregation before the shuffle)."""
    df = catalog.REGISTRY["bundle_stats"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    exchanges = [ln for ln in plan.splitlines() if "Exchange" in ln]
    assert len(exchanges) <= 4, exchanges
    assert "HashAggregate" in plan and "partial_" in plan


def test_blocks_are_shuffled_once_by_range_number(spark):
    from corpuspack.operators import bundle as B

    files = spark.createDataFrame([("b", "b/x.py", "x\n")], "bundle string, path string, content string")
    plan = B.sink_frame(B.file_blocks(files), keys=B.file_keys(files))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert main.count("Exchange") == 1 and "rangepartitioning" not in main


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    import pytest

    from corpuspack import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
