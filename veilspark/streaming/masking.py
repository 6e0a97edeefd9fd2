"""Masking as a stream: new units are masked batch by batch, with tags that stay the same across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.text import normalize, tag
from veilspark.operators.mask import job_findings, masked_text, row_key
from veilspark.operators.policy import Policy, policy
from veilspark.operators.registry import registry
from veilspark.operators.verify import left_patterns, left_values
from veilspark.sources.scratch import written


def known_tags(spark: SparkSession, tags: str, epoch: int) -> DataFrame | None:
    """entity, norm, index, value, tag of the batches before epoch; null if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tags)
    if epoch == 0 or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(tags).filter(F.col("batch") < epoch).drop("batch")


def mask_batch(df: DataFrame, epoch: int, out: str, tags: str, chosen: Policy) -> None:
    """Mask the units of one batch (unit, text, hint). Values without a tag get the next numbers of their entity, in the order
    of first sight. Masked units go to `out`/clean, those in which a gate still finds a value, or a pattern, to `out`/held. A
    batch that is run again writes the same rows."""
    spark = df.sparkSession
    df = written(df.select("unit", "text", "hint"), "batch")
    found = job_findings(df, chosen).withColumn("norm", normalize(F.col("text")))
    known = known_tags(spark, tags, epoch)
    fresh = found if known is None else found.join(known.select("entity", "norm"), ["entity", "norm"], "left_anti")
    new = registry(fresh.select("entity", "ord", "text"))
    if known is not None:
        last = known.groupBy("entity").agg((F.max("index") + 1).alias("n"))  # a row an entity
        new = new.join(F.broadcast(last), "entity", "left").withColumn("index", F.col("index") + F.coalesce("n", F.lit(0))).drop("n")
    new = new.withColumn("tag", tag(F.col("entity"), F.col("index"), chosen.tag_template, chosen.short_names))
    new.select("entity", "norm", "index", "value", "tag").write.mode("overwrite").parquet(f"{tags}/batch={epoch}")
    mine = spark.read.parquet(f"{tags}/batch={epoch}").select("entity", "norm", "tag")
    every = mine if known is None else known.select("entity", "norm", "tag").union(mine)
    marks = found.join(every, ["entity", "norm"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("marks"))
    masked = written(df.withColumn("row", row_key()).join(marks, "row", "left").select("unit", masked_text().alias("masked")), "masked")
    held = left_values(masked, found).select("unit").union(left_patterns(masked).select("unit")).distinct().withColumnRenamed("unit", "_unit")
    same = F.col("unit").eqNullSafe(F.col("_unit"))
    masked.join(held, same, "left_anti").write.mode("overwrite").parquet(f"{out}/clean/batch={epoch}")
    masked.join(held, same, "left_semi").write.mode("overwrite").parquet(f"{out}/held/batch={epoch}")


def mask_stream(units: DataFrame, out: str, tags: str, checkpoint: str, chosen: Policy | None = None) -> StreamingQuery:
    """Start a query that masks all units there are, batch by batch, and writes the registry under `tags` (see mask_batch).

    All three folders are on a file system that all nodes share."""
    chosen = chosen or policy()
    return units.writeStream.foreachBatch(lambda df, epoch: mask_batch(df, epoch, out, tags, chosen)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
