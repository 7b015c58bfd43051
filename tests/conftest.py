import pytest
from pyspark.sql import SparkSession

from sentrel.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files_of(spark):
    """A ``files`` table from ``{path: text}`` or ``{(repo, path): text}``."""
    from sentrel.functions.text import detect_language
    from pyspark.sql import functions as F

    def make(texts: dict):
        rows = [(*(k if isinstance(k, tuple) else ("r", k)), t) for k, t in texts.items()]
        df = spark.createDataFrame(rows, "repo string, path string, text string")
        return df.select(
            "repo", "path", F.octet_length("text").cast("long").alias("size"), "text", detect_language(F.col("path")).alias("language")
        )

    return make
