import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codesieve.session import build_session

    session = build_session("codesieve-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="codesieve-tests-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files_of(spark):
    """files_of({path: content}) with the language taken from the extension."""
    from codesieve.functions.paths import dotted_extension
    from codesieve.functions.text import content_hash
    from codesieve.operators.inventory import rule_language
    from pyspark.sql import functions as F

    def build(contents, repo="/r"):
        rows = [(repo, path, text) for path, text in contents.items()]
        df = spark.createDataFrame(rows, "repo_path string, file_path string, content string")
        return df.withColumn("language", rule_language(dotted_extension(F.col("file_path")))).withColumn(
            "content_hash", content_hash(F.col("content")))

    return build
