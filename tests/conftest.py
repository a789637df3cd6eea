import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def graph(spark):
    """Nodes 1..50 with parents k div 2 (is_a) and k div 3 (part_of)."""
    rows = [(k, k // 2, "is_a") for k in range(2, 51)] + [(k, k // 3, "part_of") for k in range(3, 51)]
    return spark.createDataFrame(rows, "child int, parent int, rel string")


@pytest.fixture(scope="session")
def closed(graph):
    from enrichspark.operators.dag import closure
    from enrichspark.session import materialize
    return materialize(closure(graph))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
