"""Tables written on the way: read many times, computed once, and safe from lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a local master (tests on one machine) names no shared folder.
LOCAL = "/tmp/checkpoints/veilspark"
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local master gets a local one; a cluster, whose nodes
    would not see each other's, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        root = LOCAL
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a Parquet table in the shared folder. Plans that read it several times don't compute it again."""
    path = f"{shared_dir(df.sparkSession)}/masking/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has written so, and return how many. For the end of a job: what was returned before
    can't be read any more, unless it was saved."""
    n = len(_PATHS)
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by key where one part of it has more than twice its share of the rows, or parts are fewer than cores,
    which would leave some idle in work that is heavy on a row; any other table is read as it lies, without a shuffle. The rows
    are the same. A file may be split in more parts than it has row groups; those without one are empty, so rows are counted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        rows = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        if not rows[1] or rows[0] * cores <= 2 * rows[1]:
            return df
    return df.repartition(cores, key)
