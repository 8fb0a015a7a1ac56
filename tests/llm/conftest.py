import pytest


@pytest.fixture(autouse=True)
def _few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
