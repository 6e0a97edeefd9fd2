"""Positioned tokens: label distances, segments as text, spans back to tokens, OCR tables, barcodes, signature regions.

Tables of tokens have unit, page, tok (the order of reading), line, x0, y0, x1, y1 (shares of the page; null without a box),
text, and perhaps confidence. What joins two tokens of a page meets by unit, page and a band of the height, never by page alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.labels import ID_LABELS, PROVIDER_LABELS
from veilspark.functions.text import TOKEN_EDGES, looks_read
from veilspark.operators.context import Adjacency, neighbours
from veilspark.operators.detect import AGE, AGE_LABEL, CANDIDATE, MAX_AGE, OCR_NOISE
from veilspark.operators.geometry import SIDES, area, common_area
from veilspark.operators.policy import Policy
from veilspark.operators.tokens import places, slices

#: What counts as money, and as an identifier on a barcode; labels of signatures.
MONEY = r"^\$?\d{1,3}(?:,\d{3})+(?:\.\d{2})?$|^\$?\d+\.\d{2}$"
PAYLOAD = r"\d{6,}"
SIGNATURE_LABELS = ("signature", "signed", "sign here", "authorized by")
#: A page whose text layer has fewer characters is read by OCR as a whole.
LEAST_CHARACTERS = 20


def label_matches(tokens: DataFrame, chosen: Policy, near: Adjacency = Adjacency()) -> DataFrame:
    """unit, page, tok, entity, distance: of each token the label nearest to it, among the words to its left and above.

    Distances are shares of the gap that each direction allows, so a label beside a value can win over a heading above it. A
    label counts as near as the nearest of its words; equal ones go by the order of groups, then of labels. Where
    professionals are kept, their labels compete under the entity PROVIDER. Words are in reading order, so a label is found
    where it is printed in a row."""
    groups = list(ID_LABELS.items()) + ([] if chosen.mask_providers else [("PROVIDER", PROVIDER_LABELS)])
    near_words = neighbours(tokens, near)
    ordered = F.array_sort(F.collect_list(F.struct("line", "x0", F.lower("text").alias("text"), "distance")))
    held = near_words.groupBy("unit", "page", "tok").agg(ordered.alias("words"))  # at most near.window words
    table = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(i).alias("nth"), F.lit(entity).alias("entity"), F.lit(label).alias("label")) for g, (entity, labels) in enumerate(groups) for i, label in enumerate(labels)])
    context = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    wanted = held.withColumn("context", context).select("*", F.explode(F.filter(table, lambda x: F.col("context").contains(x["label"]))).alias("l"))
    quoted = F.concat(F.lit(r"(?<!\w)\Q"), F.col("l.label"), F.lit(r"\E(?!\w)"))
    places = F.transform(F.sequence(F.lit(1), F.length("context")), lambda p: F.when(F.substring("context", p, F.length("l.label")) == F.col("l.label"), p - 1))
    found = wanted.filter(F.rlike("context", quoted)).withColumn("at", F.explode(F.array_compact(places)))
    before, after = F.substring("context", F.col("at"), F.lit(1)), F.substring("context", F.col("at") + F.length("l.label") + 1, F.lit(1))
    found = found.filter(((F.col("at") == 0) | ~before.rlike(r"(?U)\w")) & ~after.rlike(r"(?U)\w"))
    # The word in which each character of the context lies; a blank belongs to the word after it.
    lengths = F.transform("words", lambda w: F.length(w["text"]))
    starts = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.aggregate(F.slice(lengths, F.lit(1), i - 1), F.lit(0), lambda a, n: a + n + 1))
    inside = F.filter(F.arrays_zip(F.col("words"), starts.alias("start")), lambda x: (x["start"] - 1 < F.col("at") + F.length("l.label")) & (x["start"] + F.length(x["words"]["text"]) > F.col("at")))
    scored = found.withColumn("distance", F.array_min(F.transform(inside, lambda x: x["words"]["distance"])))
    best = scored.groupBy("unit", "page", "tok").agg(F.min(F.struct("distance", "l.group", "l.nth", "l.entity")).alias("b"))
    return best.select("unit", "page", "tok", F.col("b.entity").alias("entity"), F.col("b.distance").alias("distance"))


def labelled_values(tokens: DataFrame, chosen: Policy, near: Adjacency = Adjacency()) -> DataFrame:
    """unit, page, tok, entity, text, score, source of tokens that their neighbours' labels prove: ages, and identifiers."""
    bare = F.btrim("text", F.lit(TOKEN_EDGES))
    clean = F.regexp_replace(bare, OCR_NOISE, "")
    years = F.regexp_extract(bare, AGE, 1).try_cast("int")
    digits = tokens.filter(F.col("text").rlike("[0-9]")).withColumn("bare", bare).withColumn("is_age", bare.rlike(AGE))
    context = neighbours(tokens, near).groupBy("unit", "page", "tok").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))), lambda x: x["text"]), " ")).alias("context"))
    ages = digits.filter(F.col("is_age") & years.between(chosen.min_masked_age, MAX_AGE)).join(context, ["unit", "page", "tok"], "left")
    ages = ages.filter(F.lower("bare").rlike("year|yr") | F.coalesce(F.col("context").rlike(AGE_LABEL), F.lit(False))).select("unit", "page", "tok", F.lit("AGE").alias("entity"), F.col("bare").alias("text"))
    shaped = F.length(clean).between(4, 64) & clean.rlike(r"\d") & clean.rlike(CANDIDATE) & ~clean.rlike(r"\d\.\d")
    ids = digits.filter(~F.col("is_age") & shaped).join(label_matches(tokens, chosen, near), ["unit", "page", "tok"]).select("unit", "page", "tok", "entity", F.col("bare").alias("text"))
    return ages.union(ids).filter(F.col("entity").isin(*chosen.entities, *(() if chosen.mask_providers else ("PROVIDER",)))).select("*", F.lit(0.8).alias("score"), F.lit("spatial").alias("source"))


def segment_texts(tokens: DataFrame) -> DataFrame:
    """unit, page, line, seg, text and tokens (tok, start, end in that text) of tokens with seg: their words with single blanks."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("x0", F.col("tok").cast("double")).alias("at"), "tok", "text")))
    lengths = lambda ws: F.transform(ws, lambda w: F.length(w["text"]))
    start = lambda ws, i: F.aggregate(F.slice(lengths(ws), F.lit(1), i), F.lit(0), lambda a, n: a + n + 1)
    out = tokens.groupBy("unit", "page", "line", "seg").agg(parts.alias("ws"))  # the words of one line
    return out.select("unit", "page", "line", "seg", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), F.transform("ws", lambda w, i: F.struct(w["tok"].alias("tok"), start(F.col("ws"), i).alias("start"), (start(F.col("ws"), i) + F.length(w["text"])).alias("end"))).alias("tokens"))


def localised(matches: DataFrame, tokens: DataFrame) -> DataFrame:
    """matches (unit, page, span, tokens, start, end: of a segment's text) with toks, and text: the whole tokens that each
    touches, joined by blanks. tokens: unit, page, tok, text."""
    touched = F.filter("tokens", lambda t: (t["start"] < F.col("end")) & (t["end"] > F.col("start")))
    rows = matches.select("unit", "page", "span", F.explode(F.transform(touched, lambda t: t["tok"])).alias("tok"))
    words = rows.join(tokens.select("unit", "page", "tok", "text"), ["unit", "page", "tok"])
    ordered = F.array_sort(F.collect_list(F.struct("tok", "text")))
    found = words.groupBy("unit", "page", "span").agg(ordered.alias("ws"))
    return found.select("unit", "page", "span", F.transform("ws", lambda w: w["tok"]).alias("toks"), F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"))


def without_money(spans: DataFrame) -> DataFrame:
    """Rows (unit, span, tok, text, ...) of spans of two tokens or more without those that are money; spans of one stay."""
    n = F.count("*").over(Window.partitionBy("unit", "span"))
    return spans.withColumn("_n", n).filter((F.col("_n") == 1) | ~F.trim("text").rlike(MONEY)).drop("_n")


def barcode_spans(payloads: DataFrame) -> DataFrame:
    """payloads (unit, page, tok, text; perhaps a box) that hold an identifier, a run of six digits, as spans of no length."""
    return payloads.filter(F.col("text").rlike(PAYLOAD)).select(*payloads.columns, F.lit("ACCOUNT_NUMBER").alias("entity"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.9).alias("score"), F.lit("barcode").alias("source"))


def decodable(payloads: DataFrame) -> DataFrame:
    """Gate 3: unit and value, a line a page, for pages of finished output on which a barcode still gives an identifier."""
    left = payloads.filter(F.col("text").rlike(PAYLOAD)).select("unit", "page").distinct()
    return left.select("unit", F.concat(F.lit("decodable symbol on page "), (F.col("page") + 1).cast("string")).alias("value"))


def clipped_regions(regions: DataFrame, least: float = 1e-4) -> DataFrame:
    """regions (unit, page and two corners in any order) within the page, less those of hardly any width or height."""
    low = lambda a, b: F.greatest(F.least(a, b), F.lit(0.0))
    high = lambda a, b: F.least(F.greatest(a, b), F.lit(1.0))
    box = {"x0": low("x0", "x1"), "y0": low("y0", "y1"), "x1": high("x0", "x1"), "y1": high("y0", "y1")}
    return regions.withColumns(box).filter((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))


def merged_regions(regions: DataFrame) -> DataFrame:
    """unit, page and a box for each set of regions that overlap, also by way of the box around others. Regions of one page
    are folded in the order of their corners."""

    def meet(a: list[float], b: list[float]) -> bool:
        return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done: list[list[float]] = []
        for box in sorted(pdf[list(SIDES)].to_numpy().tolist()):
            while hits := [b for b in done if meet(box, b)]:
                done = [b for b in done if b not in hits]
                box = [min(x[0] for x in (box, *hits)), min(x[1] for x in (box, *hits)), max(x[2] for x in (box, *hits)), max(x[3] for x in (box, *hits))]
            done.append(box)
        return pd.DataFrame([(*key, *b) for b in done], columns=["unit", "page", *SIDES])

    return regions.groupBy("unit", "page").applyInPandas(fold, f"unit {regions.schema['unit'].dataType.simpleString()}, page int, x0 double, y0 double, x1 double, y1 double")


def pixel_box(width: Column, height: Column) -> dict[str, Column]:
    """A region's pixels, rounded outwards and within the image; as shares of the page again when divided by its size."""
    edge = lambda c, size, up: F.least(F.ceil(F.col(c) * size), size) if up else F.greatest(F.floor(F.col(c) * size), F.lit(0))
    return {"px0": edge("x0", width, False), "py0": edge("y0", height, False), "px1": edge("x1", width, True), "py1": edge("y1", height, True)}


def mapped_back(tokens: DataFrame) -> DataFrame:
    """Tokens read from a crop (rx0, ry0, rx1, ry1 on the page), boxes in shares of the crop, with boxes in shares of the page."""
    x = lambda c: F.col("rx0") + F.col(c) * (F.col("rx1") - F.col("rx0"))
    y = lambda c: F.col("ry0") + F.col(c) * (F.col("ry1") - F.col("ry0"))
    return tokens.withColumns({"x0": x("x0"), "y0": y("y0"), "x1": x("x1"), "y1": y("y1")}).drop("rx0", "ry0", "rx1", "ry1")


def needs_ocr(pages: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """unit and needed of pages (unit, page, n_chars): whether any page has too little of a text layer."""
    return pages.groupBy("unit").agg(F.bool_or(F.col("n_chars") < least).alias("needed"))


def readable(tokens: DataFrame, engine: str) -> DataFrame:
    """Tokens of an OCR engine (confidence from 0 to 1, or to 100 of one that says so) that are sure enough to keep: lines of
    paddle from 0.3, words of tesseract from 40 or with four letters and digits at least; others keep all."""
    if engine == "paddle":
        return tokens.filter("confidence >= 0.3")
    if engine == "tesseract":
        return tokens.filter((F.col("confidence") >= 40) | (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 4))
    return tokens


#: Engines in the order in which one is chosen.
ENGINES = ("onnx", "tesseract", "paddle", "rapidocr", "doctr")


def engine_name(installed: set[str], asked: str = "auto") -> str | None:
    """The engine asked for, or the first installed one; null where none is."""
    if asked != "auto":
        return asked if asked in installed else None
    return next((e for e in ENGINES if e in installed), None)


def loop_engine_name(primary: str, installed: set[str], asked: str = "auto") -> str:
    """The engine for reading masked pages again: the same, the one asked for, or the quickest that is installed."""
    if asked == "same":
        return primary
    if asked != "auto":
        return asked if asked in installed else primary
    return "tesseract" if "tesseract" in installed else primary


def words_of_lines(lines: DataFrame) -> DataFrame:
    """lines (unit, page, line, text, a box) as words with boxes that share the width out by characters and meet half way, so
    that they tile the line. Each row is a line by itself; nothing is shuffled."""
    names = ["unit", "page", "line", "nth", "text", "x0", "y0", "x1", "y1"]

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, nth, _, start, end, length, text = places(batch.column("text"))
            x0, x1 = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("x0", "x1"))
            left, right = (x0 + (x1 - x0) * n / length[row] for n in (start, end))
            same = row[1:] == row[:-1]
            half = (right[:-1] + left[1:]) / 2
            low, high = x0.copy(), x1.copy()
            low[1:], high[:-1] = np.where(same & ~np.isnan(half), half, x0[1:]), np.where(same & ~np.isnan(half), half, x1[:-1])
            taken = lambda c, b=batch, r=pa.array(row): b.column(c).take(r)
            yield pa.RecordBatch.from_arrays([*map(taken, names[:3]), pa.array(nth), text, pa.array(low, from_pandas=True), taken("y0"), pa.array(high, from_pandas=True), taken("y1")], names)

    of = lines.withColumns({c: F.col(c).cast("double") for c in ("x0", "x1")}).select("unit", "page", "line", "text", "x0", "y0", "x1", "y1")
    schema = T.StructType([T.StructField("nth", T.IntegerType()) if c == "nth" else T.StructField(c, of.schema[c].dataType) for c in names])
    return of.mapInArrow(boxed, schema)


def without_repeats(tokens: DataFrame, limit: float = 0.3) -> DataFrame:
    """Tokens of OCR in their order (tok), less each that overlaps an earlier one that stays and has the same letters in any case.
    Only tokens of one word of one page are ever held against each other, in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        rows = []
        for i, b in zip(pdf.sort_values("tok").index, pdf.sort_values("tok")[list(SIDES)].to_numpy().tolist(), strict=True):
            size = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
            both = lambda x, y: max(min(x[2], y[2]) - max(x[0], y[0]), 0) * max(min(x[3], y[3]) - max(x[1], y[1]), 0)
            if not any((small := min(size(b), size(k))) > 0 and both(b, k) / small > limit for k in kept):
                kept.append(b)
                rows.append(i)
        return pdf.loc[rows].drop(columns="_word")

    return tokens.withColumn("_word", F.lower("text")).groupBy("unit", "page", "_word").applyInPandas(fold, tokens.schema)


def signature_regions(tokens: DataFrame) -> DataFrame:
    """unit, page and the box in which a signature would be, for each token that names one: from the label's corner on, to the
    right and three lines down."""
    named = tokens.filter(F.lower("text").rlike("|".join(SIGNATURE_LABELS)) & F.col("x0").isNotNull())
    line = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    return named.select("unit", "page", "x0", "y0", F.least(F.col("x0") + 0.35, F.lit(1.0)).alias("x1"), F.least(F.col("y1") + 3 * line, F.lit(1.0)).alias("y1"))


def pixels(width: Column, height: Column) -> dict[str, Column]:
    """A box in pixels of an image."""
    return {"x0": F.col("x0") * width, "y0": F.col("y0") * height, "x1": F.col("x1") * width, "y1": F.col("y1") * height}


def turned(degrees: float, width: Column, height: Column) -> dict[str, Column]:
    """The box around a box that is turned with its page, by degrees about the page's centre, in shares of the page."""
    t = F.radians(F.lit(degrees))
    corners = [(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    dx, dy = (lambda x: (F.col(x) - 0.5) * width), (lambda y: (F.col(y) - 0.5) * height)
    xs = [(dx(x) * F.cos(t) - dy(y) * F.sin(t)) / width + 0.5 for x, y in corners]
    ys = [(dx(x) * F.sin(t) + dy(y) * F.cos(t)) / height + 0.5 for x, y in corners]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def captioned(regions: DataFrame, tokens: DataFrame, sure: float = 0.6) -> DataFrame:
    """regions (unit, page, box) of ink with an unreadable caption on the same line just to the left: a token (text, confidence)
    that is not sure or doesn't look read, where no readable one names a signature."""
    r, t = regions.alias("r"), tokens.filter("x0 is not null").alias("t")
    line = F.least(F.col("t.y1") - F.col("t.y0"), F.col("r.y1") - F.col("r.y0"))
    level = (line > 0) & (F.least("t.y1", "r.y1") - F.greatest("t.y0", "r.y0") >= 0.5 * line)
    beside = (F.col("r.unit") == F.col("t.unit")) & (F.col("r.page") == F.col("t.page")) & level & (F.col("r.x0") - F.col("t.x1")).between(-0.02, 0.06)
    named = F.lower("t.text").rlike("|".join(SIGNATURE_LABELS))
    garbled = (F.col("t.confidence") < sure) | ~looks_read(F.col("t.text"))
    return r.join(t, beside & named, "left_anti").join(t, beside & garbled & ~named, "left_semi")


def covering(truth: DataFrame, drawn: DataFrame) -> DataFrame:
    """unit, box, drawn_box and share: how much of each true box a drawn one covers, where they meet."""
    a, b = truth.alias("a"), drawn.alias("b")
    meet = (F.col("a.unit") == F.col("b.unit")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, meet).select(F.col("a.unit").alias("unit"), F.col("a.box").alias("box"), F.col("b.box").alias("drawn_box"), (common_area("a", "b") / area("a")).alias("share"))
