import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    from fixtures_llm import write_tables

    return write_tables(spark, str(tmp_path_factory.mktemp("edges")))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    from fixtures_llm import write_tables

    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), rows=[], items=[],
                        labels=[])


@pytest.fixture()
def small_batches(spark):
    """Arrow batches of a few rows, so lists and texts go over batch ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)
