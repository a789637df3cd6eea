"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner true
    sizes, so that broadcast decisions downstream rest on a measured table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows that one task of a heavy join or aggregation should hold.
ROWS_PER_TASK = 1 << 20


def wide(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash partition by the keys of the next step into tasks of at most about ROWS_PER_TASK of its rows.

    The session's number of shuffle partitions stays the same when tables grow, and adaptive execution merges partitions by their
    compressed bytes, so a task's memory would grow with the tables. What fits one task is returned as it is. Both sides of a join need
    the same rows and keys.
    """
    n = -(-rows // ROWS_PER_TASK)
    return df if n <= 1 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash partition by the keys of the next step, at twice the session's width.

    For work that is heavy per row but light in bytes: adaptive execution would otherwise merge such small
    partitions into a few tasks. The window or aggregation that follows on the same keys reuses this exchange. At the session's
    own width the planner would drop it after a join or aggregation on the same keys, whose exchange is merged. With rows, those
    that the next steps make, a task gets at most about ROWS_PER_TASK of them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2 * n, -(-rows // ROWS_PER_TASK)), *keys)
