import pytest
from pyspark.sql import DataFrame


@pytest.fixture
def documents(spark):
    """Rows as a table with extra columns whose names operators also use."""
    def make(rows) -> DataFrame:
        return spark.createDataFrame([(d, t, "x", None, i) for i, (d, t) in enumerate(rows)],
                                     "doc_id bigint, text string, score string, spans string, n bigint")
    return make
