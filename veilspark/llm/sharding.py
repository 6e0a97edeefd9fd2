"""Shards of nearly equal bytes from indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import skew_join, staged

#: Groups that one task differences, about; the number of blocks follows the number of groups.
GROUPS_A_BLOCK = 20_000
#: Partial partitions that one task combines; a round of tasks leaves one for each so many blocks.
BLOCKS_A_TASK = 1_000
#: Rows that are numbered in one task, about.
ROWS_A_SLOT_BUCKET = 50_000


def differenced(partitions: list[tuple[list[int], list]]) -> tuple[list[int], list]:
    """Karmarkar-Karp: combine the two partial partitions of largest spread, one in falling and the other in rising order,
    until one is left. A partition is (sums, parts), parts[i] a tree of the items whose sizes add to sums[i]: None, an item
    in a list, or a pair of trees."""
    heap = []
    for i, (sums, parts) in enumerate(partitions):
        both = sorted(zip(sums, parts, strict=True), key=lambda x: -x[0])
        heap.append((-(both[0][0] - both[-1][0]), i, [x[0] for x in both], [x[1] for x in both]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s, p = heapq.heappop(heap)
        _, _, t, q = heapq.heappop(heap)
        both = sorted(((a + b, x if y is None else y if x is None else (x, y)) for a, x, b, y in zip(s, p, reversed(t), reversed(q), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (-(both[0][0] - both[-1][0]), n, [x[0] for x in both], [x[1] for x in both]))
        n += 1
    return heap[0][2], heap[0][3]


def leaves(tree) -> list:
    found, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        elif x is not None:
            found += x
    return found


def single(size: int, item, shards: int) -> tuple[list[int], list]:
    return [size] + [0] * (shards - 1), [[item]] + [None] * (shards - 1)


def group_shards(groups: DataFrame, shards: int, n_groups: int, groups_a_block: int = GROUPS_A_BLOCK, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """groups (digest, size) with a shard each. Blocks of groups are differenced in parallel into `shards` partial sums; these
    partial partitions are differenced again, blocks_a_task of them in a task, round after round until one is left. The driver
    holds neither groups nor sums, and a round has a row for each block and shard."""
    blocks = max(1, -(-n_groups // groups_a_block))

    def one_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "digest"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sums, parts = differenced([single(int(s), i, shards) for i, s in enumerate(pdf["size"])])
        local = [0] * len(pdf)
        for part, tree in enumerate(parts):
            for i in leaves(tree):
                local[i] = part
        return pd.DataFrame({"block": key[0], "digest": pdf["digest"], "size": pdf["size"], "part": local})

    def combined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the parts of some blocks the part of the combined partition that each goes to."""
        sums: dict[int, list[int]] = {}
        for b, p, size in zip(pdf["block"].tolist(), pdf["part"].tolist(), pdf["size"].tolist(), strict=True):
            sums.setdefault(b, [0] * shards)[p] = size
        _, parts = differenced([(s, [[(b, i)] for i in range(shards)]) for b, s in sorted(sums.items())])
        rows = [(key[0], b, i, part) for part, tree in enumerate(parts) for b, i in leaves(tree)]
        return pd.DataFrame(rows, columns=["into", "block", "part", "onto"])

    dealt = groups.select("digest", "size", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int").alias("block"))
    local = staged(dealt.groupBy("block").applyInPandas(one_block, "block int, digest binary, size long, part int"), "parts")
    place = None  # block, part: of the first blocks; now_block, now_part: where they are by now
    sums = local.groupBy("block", "part").agg(F.sum("size").alias("size"))
    while blocks > 1:
        sums = staged(sums, "sums")
        moves = staged(sums.groupBy(F.floor(F.col("block") / blocks_a_task).cast("int").alias("into")).applyInPandas(combined, "into int, block int, part int, onto int"), "moves")
        step = moves.select(F.col("block").alias("now_block"), F.col("part").alias("now_part"), "into", "onto")
        if place is None:
            place = step.select(F.col("now_block").alias("block"), F.col("now_part").alias("part"), F.col("into").alias("now_block"), F.col("onto").alias("now_part"))
        else:
            place = place.join(step, ["now_block", "now_part"]).select("block", "part", F.col("into").alias("now_block"), F.col("onto").alias("now_part"))
        sums = sums.join(moves, ["block", "part"]).groupBy(F.col("into").alias("block"), F.col("onto").alias("part")).agg(F.sum("size").alias("size"))
        blocks = -(-blocks // blocks_a_task)
    if place is None:
        return local.select("digest", F.col("part").alias("shard"))
    return local.join(place, ["block", "part"]).select("digest", F.col("now_part").alias("shard"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs (doc_id, text).

    Law `bytes`: rows of equal text are one indivisible group, and shards have nearly equal sums of size, which is the UTF-8
    length of the text plus 1. A null text counts as empty (size 1, CRC 0) and belongs to the group of empty texts. Slots
    number the rows of a shard from 0, in the order of a hash of doc_id. Equal rows get slots of their own. grown_shard is
    null. doc_id may be of any type and null. An empty table gives no rows. A group larger than a shard's share fills a shard alone as far as others allow.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest")), "rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    n_rows = rows.count()
    placed = staged(skew_join(rows, group_shards(groups, shards, groups.count()), "digest", "inner", F.col("doc_id"), n_rows), "placed")

    buckets = max(1, -(-n_rows // (shards * ROWS_A_SLOT_BUCKET)))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").count()
    offsets = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("offset"))
    by = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "digest")
    slot = (F.col("offset") + F.row_number().over(by) - 1).alias("slot")
    return dealt.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
