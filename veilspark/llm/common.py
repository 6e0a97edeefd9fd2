"""What the corpus operators share: scratch tables, joins that survive a hot key, word classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the document contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a local master (tests on one machine) names no shared folder.
LOCAL_SCRATCH = "/tmp/checkpoints/veilspark"
#: A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
HOT_LEAST = 2000
#: Parts into which the rows of a hot key are dealt.
SALTS = 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where it is unset, a local master gets a local one; a cluster, whose
    nodes would not see each other's, is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        root = LOCAL_SCRATCH
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing before it."""
    spark, path = df.sparkSession, new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Keys with more than HOT_LEAST rows and more than 1/HOT_SHARE of all rows: fewer than HOT_SHARE rows, safe to broadcast."""
    total = df.count() if total is None else total
    return df.groupBy(key).count().filter(is_hot("count", total)).select(key, F.lit(True).alias("_hot"))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, spread: Column, total: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """left joined with right (one row a key) on key, inner or left. Rows of hot keys of left are dealt over SALTS parts
    by spread and right's rows of these keys are repeated for each part. left is read twice, so it should be a staged table.
    hot: keys known to be hot, fewer than HOT_SHARE, where the caller has counted them already."""
    hot = hot_keys(left, key, total) if hot is None else hot.select(key, F.lit(True).alias("_hot"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread_right = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(spread_right, [key, "_salt"], how).drop("_salt")


def is_hot(count: str, total: int) -> Column:
    """Whether a key with so many rows of total is hot; fewer than HOT_SHARE keys are."""
    return (F.col(count) > HOT_LEAST) & (F.col(count) * HOT_SHARE > F.lit(total))


def parts_between(text: Column, gap: str) -> Column:
    """Number of runs between matches of gap; null has none. Splitting is several times faster than counting matches."""
    parts = F.split(text, gap, -1)
    ends = (F.get(parts, F.lit(0)) == "").cast("long") + ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("long")
    return F.coalesce(F.size(parts).cast("long") - ends, F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """Number of words in a text, between ASCII white space; null has none."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(parts_between(text, r"[\x20\x09-\x0D]+"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Bound the rows of an Arrow batch while a table is written within, as single texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
