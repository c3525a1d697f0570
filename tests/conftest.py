import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gatecount.session import session

    spark = session("tests", 8)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal inputs: one(column, name=value, ...)."""
    from pyspark.sql import functions as F

    def run(column, **inputs):
        literals = []
        for k, v in inputs.items():
            if isinstance(v, list):
                v = F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
            else:
                v = F.lit(v)
            literals.append(v.alias(k))
        return spark.range(1).select(*literals, F.lit(0).alias("_")).select(column.alias("r")).first()["r"]

    return run
