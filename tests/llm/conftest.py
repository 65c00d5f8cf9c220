import pytest
from pyspark.sql import functions as F

from .brute import ODD

SF_DIR = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASHING = ("n_words", "score", "kept", "id", "class", "name", "component", "text_", "copy", "mix_key", "rule", "hit")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with other columns named like those of the operators, in four partitions."""
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return rows.withColumns({name: F.lit(f"{name}!") for name in CLASHING}).repartition(4)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
