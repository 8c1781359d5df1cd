import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows, with two columns whose names clash with names that operators use."""
    def make(rows, schema, parts=3):
        df = spark.createDataFrame(rows, schema).withColumns({"block": F.lit("x"), "shard": F.lit(7), "score": F.lit("s"), "kind": F.lit(1), "n": F.lit(2)})
        from fluxprint.session import materialize

        return materialize(df.repartition(parts), "fixture")

    return make
