import duckdb
import pytest

from dimsift.llm.tokenizer_file import TokenizerFile, default_path

from ..conftest import DATA

SCHEMA = "doc_id long, text string"
# empty, white space only, null, no id, repeated rows, separators that look alike
ODD = [(1, ""), (2, " \n\t"), (3, None), (None, "no id here"), (4, "x"), (4, "x"), (5, "a b c\x1cd"), (6, "\U0001f642 " * 3)]


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents, with columns named as operators name theirs."""

    def make(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        return df.selectExpr("doc_id", "text", "1 AS n_words", "2 AS node", "'k' AS key", "3 AS edge", "4 AS _key", "5 AS label")

    return make


@pytest.fixture(scope="session")
def byte_file(spark):
    return TokenizerFile(spark, default_path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def word_file(spark):
    return TokenizerFile(spark, default_path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con
