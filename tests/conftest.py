import os
import shutil

import pytest

from loomline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from pyspark.sql import SparkSession

    warehouse = tmp_path_factory.mktemp("warehouse")
    SparkSession.builder.config("spark.sql.warehouse.dir", str(warehouse)).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    s = local_session("4", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(warehouse, ignore_errors=True)


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples, columns in alphabetical order."""

    def get(df):
        names = sorted(df.columns)
        return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)

    return get
