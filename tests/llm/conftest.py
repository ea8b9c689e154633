import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, in four partitions."""

    def build(pairs, extra=None):
        rows = [(i, t, None, None, None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS).repartition(4)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
