import pytest


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) with the other columns filled in, and a column with a clashing name."""

    def make(*rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(list(rows), schema)
        from pyspark.sql import functions as F

        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), "component_id": F.lit(-1), "digest": F.lit("x"), "n": F.lit(0)})

    return make
