"""Boxes on pages: padding, overlap, what is already covered, and scores against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def area(b: str) -> Column:
    return F.greatest(F.col(f"{b}.x1") - F.col(f"{b}.x0"), F.lit(0.0)) * F.greatest(F.col(f"{b}.y1") - F.col(f"{b}.y0"), F.lit(0.0))


def common_area(a: str, b: str) -> Column:
    across = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    down = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def padded(boxes: DataFrame, share: float = 0.12, ocr_dates: str | None = None) -> DataFrame:
    """boxes grown by share of their height on every side, within the page; OCR dates (a flag column) by 1.5 heights to the right."""
    h = F.col("y1") - F.col("y0")
    right = F.when(F.col(ocr_dates), F.greatest(share * h, 1.5 * h)).otherwise(share * h) if ocr_dates else share * h
    page = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return boxes.withColumns({"x0": page(F.col("x0") - share * h), "y0": page(F.col("y0") - share * h), "x1": page(F.col("x1") + right), "y1": page(F.col("y1") + share * h)})


def not_overlapping(tokens: DataFrame, others: DataFrame, limit: float = 0.3) -> DataFrame:
    """tokens of which no box of others on the same (unit, page) covers more than limit of the smaller area."""
    a, b = tokens.alias("a"), others.select("unit", "page", *SIDES).alias("b")
    hit = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.page") == F.col("b.page")) & (common_area("a", "b") > limit * F.least(area("a"), area("b")))
    return a.join(b, hit, "left_anti")


def not_covered(rects: DataFrame, drawn: DataFrame, share: float = 0.5) -> DataFrame:
    """Spans (unit, span) of rects with a rectangle that no single drawn box covers by more than share."""
    a, b = rects.alias("a"), drawn.select("unit", "page", *SIDES).alias("b")
    hit = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.page") == F.col("b.page")) & (common_area("a", "b") > share * area("a"))
    return a.join(b, hit, "left_anti").select("unit", "span").distinct()


def _overlaps(truth: DataFrame, drawn: DataFrame) -> DataFrame:
    """unit, box, drawn_box and common: the area that a true box and a drawn one of the same page share, where they meet."""
    a, b = truth.alias("a"), drawn.alias("b")
    meet = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, meet).select(F.col("a.unit").alias("unit"), F.col("a.box").alias("box"), F.col("b.box").alias("drawn_box"), common_area("a", "b").alias("common"))


def _size() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))


def covered(truth: DataFrame, drawn: DataFrame) -> DataFrame:
    """truth (unit, page, box, a rectangle, perhaps entity) with area and share: how much of it drawn boxes cover, whole at most."""
    got = _overlaps(truth, drawn).groupBy("unit", "box").agg(F.sum("common").alias("got"))
    out = truth.withColumn("area", _size()).join(got, ["unit", "box"], "left")
    return out.withColumn("share", F.when(F.col("area") > 0, F.least(F.coalesce("got", F.lit(0.0)), F.col("area")) / F.col("area")).otherwise(F.lit(0.0))).drop("got")


def scores(truth: DataFrame, drawn: DataFrame) -> DataFrame:
    """unit, n_truth, n_drawn, area_recall, area_precision, hit_recall, hit_precision, n_missed, n_under_masked.

    A true box is hit where half of it is covered, and under-masked below nine tenths (signatures and faces, if truth has
    entity, are not held to that). A drawn box is right where it meets any true one. Without true boxes recalls are 1,
    without drawn ones precisions are."""
    meet = _overlaps(truth, drawn)
    mine = covered(truth, drawn)
    text = ~F.col("entity").isin("SIGNATURE", "FACE") if "entity" in truth.columns else F.lit(True)
    recall = mine.groupBy("unit").agg(F.count("*").alias("n_truth"), (F.sum(F.col("area") * F.col("share")) / F.sum("area")).alias("area_recall"), F.avg((F.col("share") >= 0.5).cast("int")).alias("hit_recall"), F.sum((F.col("share") < 0.5).cast("long")).alias("n_missed"), F.sum(((F.col("share") < 0.9) & (F.col("area") > 0) & text).cast("long")).alias("n_under_masked"))
    on = meet.groupBy("unit", F.col("drawn_box").alias("box")).agg(F.sum("common").alias("on"))
    right = drawn.withColumn("area", _size()).join(on, ["unit", "box"], "left").fillna(0.0, ["on"])
    precision = right.groupBy("unit").agg(F.count("*").alias("n_drawn"), (F.sum(F.least("on", "area")) / F.sum("area")).alias("area_precision"), F.avg((F.col("on") > 0).cast("int")).alias("hit_precision"))
    one, none = (lambda c: F.coalesce(c, F.lit(1.0)).alias(c)), (lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c))
    return recall.join(precision, "unit", "full").select("unit", none("n_truth"), none("n_drawn"), one("area_recall"), one("area_precision"), one("hit_recall"), one("hit_precision"), none("n_missed"), none("n_under_masked"))


def mean_scores(of_units: DataFrame) -> DataFrame:
    """One row: the means of the four shares over units."""
    return of_units.agg(*[F.avg(c).alias(c) for c in ("area_recall", "area_precision", "hit_recall", "hit_precision")])


def identity_scores(before: DataFrame, after: DataFrame, values: DataFrame) -> DataFrame:
    """unit, n_values, n_leaked, recall, unreadable, over_masked, from texts (unit, text) and known values (unit, value).

    Letters and digits alone are compared. A value that the text before doesn't have is unreadable and counts neither way;
    over_masked is the share of words of four letters or more, before, that the text after has lost though no value holds
    them. Tags are left out of the text after."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    texts = before.select("unit", "text", bare("text").alias("b")).join(after.select("unit", bare(F.regexp_replace("text", r"<[A-Z]+#\d+>", " ")).alias("a")), "unit")
    needles = values.select("unit", bare("value").alias("v")).filter("v != ''")
    told = needles.join(texts.select("unit", "a", "b"), "unit").withColumn("seen", F.col("b").contains(F.col("v"))).withColumn("left", F.col("seen") & F.col("a").contains(F.col("v")))
    of_values = told.groupBy("unit").agg(F.sum(F.col("seen").cast("long")).alias("n_values"), F.sum(F.col("left").cast("long")).alias("n_leaked"), F.sum((~F.col("seen")).cast("long")).alias("unreadable"), F.array_join(F.sort_array(F.collect_list("v")), "").alias("all"))  # the values of one unit
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    both = texts.join(of_values, "unit", "left").withColumn("words", words)
    lost = F.size(F.filter("words", lambda w: ~F.col("a").contains(F.lower(w)) & ~F.coalesce("all", F.lit("")).contains(F.lower(w))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    recall = F.when(F.col("n_values") > 0, 1 - F.col("n_leaked") / F.col("n_values")).otherwise(F.lit(1.0))
    return both.select("unit", zero("n_values"), zero("n_leaked"), recall.alias("recall"), zero("unreadable"), (lost / F.greatest(F.size("words"), F.lit(1))).alias("over_masked"))
