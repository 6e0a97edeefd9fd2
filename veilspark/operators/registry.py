"""Stable tags: a number for each different value of an entity, in the order of first sight over a whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import normalize, tag

#: Order ranges that are numbered apart, so no task ranks all values of an entity.
RANGES = 256


def registry(spans: DataFrame, template: str = "<{entity}#{index}>", short: bool = True) -> DataFrame:
    """entity, norm, index, value (as first seen), tag from spans (ord, entity, text), ord being any ordered column of numbers.

    Values are first merged map-side; then they are counted by ranges of ord, and numbered within a range."""
    seen = spans.withColumn("norm", normalize(F.col("text"))).groupBy("entity", "norm").agg(F.min(F.struct("ord", "text")).alias("first"))
    ends = seen.agg(F.percentile_approx("first.ord.doc", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10_000).alias("ends"))  # one row
    ranged = seen.join(F.broadcast(ends)).withColumn("range", F.size(F.filter("ends", lambda e: e < F.col("first.ord.doc")))).drop("ends")
    counts = ranged.groupBy("entity", "range").count()
    offsets = counts.select("entity", "range", (F.sum("count").over(Window.partitionBy("entity").orderBy("range")) - F.col("count")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("entity", "range").orderBy("first.ord", "norm"))
    out = ranged.withColumn("nth", within).join(offsets, ["entity", "range"]).withColumn("index", F.col("offset") + F.col("nth") - 1)
    return out.select("entity", "norm", "index", F.col("first.text").alias("value"), tag(F.col("entity"), F.col("index"), template, short).alias("tag"))


def listed(entries: DataFrame) -> DataFrame:
    """The registry by entity and index, as a report shows it."""
    return entries.orderBy("entity", "index")


def originals(entries: DataFrame, entity: str | None = None) -> DataFrame:
    """Values as first seen, of one entity or all, by entity and index."""
    some = entries if entity is None else entries.filter(F.col("entity") == entity)
    return listed(some).select("entity", "index", "value")
