"""Tokens of flat texts and positioned pages: offsets, lines, segments, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.spans import match_places

TOKEN = r"(?U)\S+"


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def token_array(text: Column) -> Column:
    """Array of (start, g0) of the tokens of a text, g0 being the token."""
    return match_places(text, TOKEN)


#: Bytes of text whose tokens are found at once, about.
SLICE = 4 << 20
#: White space of more than one byte in UTF-8, as \s has it with (?U).
WIDE_BLANKS = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each token of texts: its row, its number in the row, line feeds before it, start and end in code points, and the
    tokens themselves as the last entry; the one before last is the number of code points of each row."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n, (_, ends, held) = len(texts), texts.buffers()
    off = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None else np.empty(0, np.uint8)
    off = off - off[0]
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if len(data) and data.max() > 127:
        for c in WIDE_BLANKS:
            code = c.encode()
            at = np.flatnonzero(data[: len(data) - len(code) + 1] == code[0])
            for i in range(1, len(code)):
                at = at[data[at + i] == code[i]]
            for i in range(len(code)):
                word[at + i] = False
    before, after = np.empty_like(word), np.empty_like(word)  # whether the neighbour is of the same row and of a token
    before[:1], before[1:], after[-1:], after[:-1] = False, word[:-1], False, word[1:]
    inner = off[(off > 0) & (off < len(data))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(off[1:], start, "right")
    counted = lambda flags: np.concatenate([np.zeros(1, np.int64), np.cumsum(flags)])
    points, breaks = counted((data & 0xC0) != 0x80), counted(data == 10)
    firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(row, minlength=n))])
    lengths = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(lengths), pa.py_buffer(data[word]))
    of = lambda counts, at: (counts[at] - counts[off[row]]).astype(np.int32)
    return row, (np.arange(len(start)) - firsts[row]).astype(np.int32), of(breaks, start), of(points, start), of(points, end), points[off[1:]] - points[off[:-1]], tokens


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one, if they are more than one, have SLICE bytes at most."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = size[at - 1] if at else 0
            to = max(int(np.searchsorted(size, done + SLICE, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def flat_tokens(units: DataFrame) -> DataFrame:
    """unit, tok, line, start, end, text of each token of units (unit, text): runs without blanks, lines counted by line feeds.
    Offsets are found in the row, over the bytes of many texts at once, so nothing is shuffled."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, tok, line, start, end, _, text = places(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(pa.array(row)), *map(pa.array, (tok, line, start, end)), text], ["unit", "tok", "line", "start", "end", "text"])

    schema = T.StructType([units.schema["unit"], *(T.StructField(c, T.IntegerType()) for c in ("tok", "line", "start", "end")), T.StructField("text", T.StringType())])
    return units.select("unit", "text").mapInArrow(found, schema)


def joined(tokens: DataFrame, sep: str = " ") -> DataFrame:
    """unit and text: the tokens in order with sep between."""
    parts = F.array_sort(F.collect_list(F.struct("tok", "text")))
    return tokens.groupBy("unit").agg(F.array_join(F.transform(parts, lambda x: x["text"]), sep).alias("text"))


def covered_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans (unit, start, end, ...) with each token that they overlap, by an equality join on unit with a range condition."""
    t = tokens.select("unit", "tok", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("text").alias("t_text"))
    return spans.join(t, "unit").filter((F.col("t_start") < F.col("end")) & (F.col("t_end") > F.col("start")))


def segments(tokens: DataFrame, gap: float = 0.03) -> DataFrame:
    """Positioned tokens (unit, page, line, x0, x1, height, tok) with seg: a line is cut where the gap exceeds max(gap, 3 heights)."""
    order = Window.partitionBy("unit", "page", "line").orderBy("x0", "tok")
    cut = (F.col("x0") - F.lag("x1").over(order) > F.greatest(F.lit(gap), 3 * F.col("height"))).cast("int")
    return tokens.withColumn("_cut", F.coalesce(cut, F.lit(0))).withColumn("seg", F.sum("_cut").over(order)).drop("_cut")


def assign_lines(tokens: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Positioned tokens (unit, page, tok, x0, y0, x1, y1) with line: in the order of centre and x0 a token joins the first
    line whose running centre is within tolerance times the smaller height. An ordered fold over one page at a time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=(pdf["y0"] + pdf["y1"]) / 2).sort_values(["_c", "x0"], kind="stable")
        lines: list[list[float]] = []
        out = []
        for c, h in zip(pdf["_c"], pdf["y1"] - pdf["y0"], strict=True):
            at = next((i for i, (lc, lh) in enumerate(lines) if abs(lc - c) <= tolerance * min(lh, h)), None)
            if at is None:
                at = len(lines)
                lines.append([c, h])
            else:
                lines[at] = [(lines[at][0] + c) / 2, max(lines[at][1], h)]
            out.append(at)
        return pdf.assign(line=out).drop(columns="_c")

    schema = tokens.drop("line").schema.add("line", T.IntegerType())
    return tokens.drop("line").groupBy("unit", "page").applyInPandas(fold, schema)


def reading_order(tokens: DataFrame) -> DataFrame:
    """tok renumbered by page, line, x0; tokens without a box come last."""
    order = Window.partitionBy("unit").orderBy("page", F.when(F.col("x0").isNull(), F.lit(10**9)).otherwise(F.col("line")), F.coalesce("x0", F.lit(0.0)), "tok")
    return tokens.withColumn("tok", (F.row_number().over(order) - 1).cast("int"))


def line_rects(tokens: DataFrame) -> DataFrame:
    """A box for each line of each span of tokens (unit, span, page, line, x0, y0, x1, y1); tokens without a box don't count."""
    return tokens.filter("x0 is not null").groupBy("unit", "span", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
