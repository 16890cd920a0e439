import pytest


@pytest.fixture
def frame(spark):
    """A table from rows and a schema, over several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
