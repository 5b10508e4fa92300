import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("doclumen-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """``{path: content}`` of one project, or ``{project: {path: content}}``, as a table."""

    def build(files, project="p"):
        nested = files if all(isinstance(v, dict) for v in files.values()) else {project: files}
        rows = [(p, path, text) for p, tree in nested.items() for path, text in tree.items()]
        return spark.createDataFrame(rows, "project string, path string, content string")

    return build
