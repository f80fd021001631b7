import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from reportlake.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def nulls(spark, table):
    """Two equal rows of nulls in a table's schema, with an extra column of a clashing name."""

    def make(name, **given):
        t = table(name)
        row = tuple(given.get(f.name) for f in t.schema.fields)
        from pyspark.sql import functions as F
        from pyspark.sql.types import StructType

        schema = StructType([type(f)(f.name, f.dataType, True) for f in t.schema.fields])
        return spark.createDataFrame([row, row], schema).withColumn("tokens", F.lit("extra")).withColumn("n", F.lit("extra"))

    return make
