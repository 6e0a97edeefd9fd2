"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import staged, words_in

#: Weights that sources take in turn, in the order of their names, null last.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
EPOCHS = 3
#: Parts of a source's shuffled documents and of the queue that are added up by themselves, as digits of a hexadecimal hash.
DIGITS = 3


def shuffle_key() -> Column:
    """A fixed hash by which documents are shuffled: of doc_id, and of the text where that is null."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with the target of each source, by filling up: shares of the total by weight, at most
    `epochs` times the source's size, what exceeds it shared again by weight. Rows are sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs).withColumn("fills", F.col("cap") / F.col("w"))
    # In the order in which sources reach their caps, k sources are at their caps and the others share the rest.
    fill = Window.orderBy("fills", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("left_w", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("before")) / F.col("left_w")).withColumn("nth", F.row_number().over(fill))
    # The first source whose cap the level doesn't pass.
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("nth", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(level, F.col("fills")))).select("source", "source_size", "target")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source; others are ignored).

    Each copy of a document (there are `epochs`) has a virtual finish time: words of its source up to and with it, in
    shuffled order and epoch after epoch, over the source's target. Copies in the order of finish times are taken while the
    sum of words keeps within the total of all sizes. Sums run in two levels: by parts of the hash or of the time, then
    within a part, so no task adds up a whole source or the whole queue.

    A null text has size 0; documents of size 0 are taken for nothing. A null source is a source of its own, the last. Ties
    in the hash go by doc_id, size; rows without doc_id are shuffled by their texts. Equal rows count each for itself. An empty table, or one without words, takes nothing.
    """
    rows = staged(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), shuffle_key().alias("h")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    part = F.substring("h", 1, DIGITS)
    parts = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("n"))
    offsets = parts.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("offset"))
    # A row for each source and part: at most 16**DIGITS a source.
    known = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"].alias("s"), F.col("part").alias("p"), "offset", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("source", part).orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("upto", within).withColumn("part", part)
    placed = summed.join(known, summed["source"].eqNullSafe(known["s"]) & (summed["part"] == known["p"]))
    placed = staged(placed.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("offset") + F.col("upto")).alias("upto")), "placed")

    copies = placed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    # Finish times up to 1 make up the targets; the cut lies there or just behind.
    fine = 16**DIGITS
    slice_ = F.when(F.col("finish") < 2, F.floor(F.col("finish") * fine)).otherwise(2 * fine + F.floor(F.log2(F.col("finish") / 2) * fine)).cast("long")
    copies = copies.withColumn("slice", slice_)
    slices = copies.groupBy("slice").agg(F.sum("size").alias("n"))
    reach = slices.select("slice", F.sum("n").over(Window.orderBy("slice")).alias("end"), "n").select("slice", "end", (F.col("end") - F.col("n")).alias("begin"))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    reach = reach.join(F.broadcast(budget))  # one row
    whole = copies.join(reach.filter("end <= budget").select("slice"), "slice")
    edge = copies.join(reach.filter("begin < budget and end > budget").select("slice", "begin", "budget"), "slice")
    queue = Window.partitionBy("slice").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "size", "upto").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.col("begin") + F.sum("size").over(queue)).filter("end <= budget")
    keys = ["doc_id", "source", "size", "upto"]
    chosen = whole.select(*keys).union(edge.select(*keys)).groupBy(*keys).agg(F.sum("size").alias("taken"))
    c = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys], "taken")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = placed.join(c, same[0] & same[1] & same[2] & same[3], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they were. Rows of the same doc_id, source and size share their copies in a fixed order."""
    plan = mixed(docs, weights, epochs).filter("taken > 0")
    keys = ["doc_id", "source", "size"]
    # Rows alike in these are told apart by number, on both sides.
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("taken")))
    c = plan.withColumn("n", number).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"), F.expr("cast(taken / size as int)").alias("_times"))
    sized = docs.withColumn("_words", words_in(F.col("text")))
    sized = sized.withColumn("_number", F.row_number().over(Window.partitionBy("doc_id", "source", "_words").orderBy(F.md5("text"))))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")) & (F.col("_number") == F.col("_n"))
    return sized.join(c, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
