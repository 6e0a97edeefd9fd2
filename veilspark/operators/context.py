"""Label context of positioned tokens: a range join on the page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adjacency:
    """How far a label may stand from its value, in page units; tolerances in token heights."""

    left_gap: float = 0.18
    above_gap: float = 0.025
    line_tolerance: float = 0.6
    column_tolerance: float = 0.10
    window: int = 10


def neighbours(tokens: DataFrame, near: Adjacency = Adjacency(), band: float = 0.05, by_share: bool = True) -> DataFrame:
    """unit, page, tok, distance, line, x0, text: for each positioned token the nearest `window` tokens to the left on its
    line or just above. distance is the gap as a share of
    what its direction allows; by_share: whether the nearest are those by that share, or by the gap itself. Tokens meet by page and horizontal band, each looked for in its own and the next ones."""
    boxed = tokens.filter("x0 is not null").withColumn("c", (F.col("y0") + F.col("y1")) / 2)
    me = boxed.withColumn("b", F.explode(F.sequence(F.floor(F.col("y0") / band) - 1, F.floor(F.col("y1") / band) + 1))).alias("t")
    other = boxed.withColumn("b", F.floor(F.col("c") / band)).alias("o")
    t, o = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"o.{c}"))
    height = F.greatest(t("y1") - t("y0"), F.lit(1e-6))
    left = (F.abs(t("c") - o("c")) <= near.line_tolerance * height) & (t("x0") - o("x1")).between(0, near.left_gap)
    above = (o("x0") - near.column_tolerance < t("x1")) & (o("x1") + near.column_tolerance > t("x0")) & (t("y0") - o("y1")).between(0, near.above_gap)
    gap = F.when(left, t("x0") - o("x1")).otherwise(t("y0") - o("y1"))
    share = F.when(left, (t("x0") - o("x1")) / near.left_gap).otherwise((t("y0") - o("y1")) / near.above_gap)
    pairs = me.join(other, (t("unit") == o("unit")) & (t("page") == o("page")) & (t("b") == o("b")) & (t("tok") != o("tok")) & (left | above))
    pairs = pairs.select(t("unit").alias("unit"), t("page").alias("page"), t("tok").alias("tok"), share.alias("distance"), gap.alias("gap"), o("line").alias("line"), o("x0").alias("x0"), o("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("unit", "page", "tok").orderBy("distance" if by_share else "gap", "line", "x0", "text"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= near.window).drop("rank", "gap")


def spatial_context(tokens: DataFrame, near: Adjacency = Adjacency(), band: float = 0.05) -> DataFrame:
    """unit, page, tok and context (lower case, in reading order) of positioned tokens: the words of their neighbours."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "x0", "text")))
    return neighbours(tokens, near, band, False).groupBy("unit", "page", "tok").agg(F.lower(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("context"))
