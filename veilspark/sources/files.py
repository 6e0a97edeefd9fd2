"""Files as units: plain text, CSV cells, Word and Excel files, read by Spark's binary source on any file system."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.verify import MaskingError
from veilspark.sources.office import PLACES, office_units

#: A unit is the place-th of its file.
UNITS = "path string, surface string, row int, col int, hint string, text string, place int"


def decoded(content: Column) -> Column:
    """UTF-8 with what isn't valid replaced."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def text_units(spark: SparkSession, path: str) -> DataFrame:
    """A unit for each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit("text").alias("surface"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("").alias("hint"), decoded(F.col("content")).alias("text"), F.lit(0).alias("place"))


def csv_cells(name: str, content: bytes) -> Iterator[tuple]:
    """Cells in order; the first row gives hints to the cells below and has none itself; short and long rows are allowed."""
    header: list[str] = []
    place = 0
    for r, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""))):
        header = cells if r == 0 else header
        for c, cell in enumerate(cells):
            yield name, "cell", r, c, header[c] if r and c < len(header) else "", cell, place
            place += 1


def text_cells(name: str, content: bytes) -> Iterator[tuple]:
    """A text file as its only unit."""
    yield name, "text", 0, 0, "", content.decode("utf-8", "replace"), 0


READERS = {".txt": text_cells, ".csv": csv_cells} | {suffix: partial(office_units, suffix) for suffix in PLACES}


def suffix_of(name: str) -> str:
    """The suffix of a file's name, in lower case; MaskingError if files of that kind can't be masked."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in READERS:
        raise MaskingError(f"unsupported file type: {suffix or 'none'}")
    return suffix


def any_units(name: str, content: bytes) -> Iterator[tuple]:
    """Units of a file by the reader for its suffix."""
    return READERS[suffix_of(name)](name, content)


def file_units(spark: SparkSession, path: str | list[str], suffix: str | None = None) -> DataFrame:
    """Units of files: .txt, .csv, .docx or .xlsx, each by its suffix, or all by the one given; another is an error."""
    if suffix is not None and suffix not in READERS:
        raise ValueError(f"unsupported file type {suffix!r}")
    return units_in(spark.read.format("binaryFile").load(path), READERS[suffix] if suffix else any_units)


def units_in(files: DataFrame, reader: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Units of files (path, content) by a reader of one file."""
    names = [f.split()[0] for f in UNITS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(reader(name, bytes(content))), columns=names)

    return files.select("path", "content").mapInPandas(read, UNITS)


def masked_name(stem: Column) -> Column:
    """A file's stem as text to detect in: separators to blanks."""
    return F.regexp_replace(stem, r"[_\-.]+", " ")


def csv_lines(cells: DataFrame, text: str = "masked") -> DataFrame:
    """path, row, line: cells (path, row, col and a text) as CSV lines with minimal quoting."""
    cell = F.coalesce(F.col(text), F.lit(""))
    quoted = F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)
    parts = F.array_sort(F.collect_list(F.struct("col", quoted.alias("q"))))
    return cells.groupBy("path", "row").agg(F.array_join(F.transform(parts, lambda x: x["q"]), ",").alias("line"))
