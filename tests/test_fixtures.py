"""The shuffle-free Spark ``files`` view gives the same rows as the documented text."""

import pytest

from corpuspack.plans.fixtures import SPARK_FILES, SPARK_FILES_REFERENCE
from tables import SF001, SF01


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_files_view_equals_reference_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = spark.sql(SPARK_FILES, documents=docs)
    b = spark.sql(SPARK_FILES_REFERENCE, documents=docs)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
