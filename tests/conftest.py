import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("dimsift-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# The hand-checked example: one query, five documents, four dimensions.
QUERY = [0.5, -0.25, 0.75, 0.25]
DOCS = {
    "1": [1.0, 0.0, 0.0, 0.0],
    "2": [0.5, 0.5, 0.5, 0.0],
    "3": [0.0, -1.0, 1.0, 0.0],
    "4": [-0.5, 0.0, 0.0, 1.0],
    "5": [0.0, 0.0, 0.5, -1.0],
}
RELEVANCE = {"1": 0, "2": 1, "3": 2, "4": 0, "5": 1}


@pytest.fixture(scope="session")
def micro(spark):
    class Micro:
        queries = spark.createDataFrame([("q", QUERY)], "query_id string, vec array<float>")
        docs = spark.createDataFrame(list(DOCS.items()), "doc_id string, vec array<float>")
        qrels = spark.createDataFrame(
            [("q", d, r) for d, r in RELEVANCE.items()], "query_id string, doc_id string, relevance int"
        )

    return Micro


def approx(values, tolerance=1e-6):
    return pytest.approx(values, abs=tolerance)
