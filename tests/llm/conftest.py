import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from {doc_id: text} or (doc_id, text, source) rows, in several partitions."""
    def make(rows, partitions=3):
        if isinstance(rows, dict):
            rows = [(k, v, "s") for k, v in rows.items()]
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENT).repartition(partitions)
    return make
