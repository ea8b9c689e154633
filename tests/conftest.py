import pytest

from concord.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate an expression over one row of literal inputs."""

    def run(build, *values):
        from pyspark.sql import functions as F

        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(build(*[F.col(n) for n in names]).alias("x")).collect()[0]["x"]

    return run
