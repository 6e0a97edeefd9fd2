"""Files in, masked files out: read, mask, rewrite, read back, and only then publish."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import partial
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.mask import marked, masked_text
from veilspark.operators.policy import Policy
from veilspark.operators.report import report
from veilspark.operators.verify import MaskingError, left_names, left_patterns, left_values, pattern_flags
from veilspark.sources.files import any_units, file_units, masked_name, suffix_of, units_in
from veilspark.sources.office import Mark, office_rewritten
from veilspark.sources.scratch import written

#: The place of a file's name among its units: after its contents.
NAME = 2**31 - 1
REWRITTEN = "path string, output string, content binary"


def _spliced(text: str, marks: list[Mark]) -> str:
    out, at = "", 0
    for start, end, tag in marks:
        out, at = out + text[at:start] + tag, end
    return out + text[at:]


def rewritten(suffix: str, content: bytes, marks: dict[int, list[Mark]]) -> bytes:
    """A file with marks put in its places; text is UTF-8, CSV has minimal quotes and ends lines with CR and LF."""
    if suffix == ".txt":
        return _spliced(content.decode("utf-8", "replace"), marks.get(0, [])).encode()
    if suffix != ".csv":
        return office_rewritten(suffix, content, marks)
    out, place = io.StringIO(newline=""), 0
    rows = csv.writer(out)
    for cells in csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline="")):
        rows.writerow([_spliced(cell, marks.get(place + k, [])) for k, cell in enumerate(cells)])
        place += len(cells)
    return out.getvalue().encode()


def named_units(spark: SparkSession, path: str | list[str], suffix: str | None) -> DataFrame:
    """Units of files and of their names, written once, with a unit number that follows path and place."""
    units = file_units(spark, path, suffix).select("path", "surface", "hint", "text", "place")
    stem = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)\.[^./]*$", 1)
    names = spark.read.format("binaryFile").load(path).select("path", F.lit("name").alias("surface"), F.lit("").alias("hint"), masked_name(stem).alias("text"), F.lit(NAME).alias("place"))
    return written(units.unionByName(names).orderBy("path", "place").withColumn("unit", F.monotonically_increasing_id()), "units")


def mask_files(spark: SparkSession, path: str | list[str], suffix: str | None, out: str, chosen: Policy | None = None, verify: bool = True, values: bool = False, propagate: str | None = None, keep_names: bool = False, each: bool = False) -> DataFrame:
    """Mask the files at path (a glob, a folder or a list) into folder out, which all nodes share, and return a report for each.

    suffix: that of all files; null tells each by its own. Tags are numbered over all files by path and place; propagate also
    carries values from file to file, and into names (see job_findings). Rewritten files are held in the shared scratch folder
    and read back. If a gate finds something, MaskingError is raised with counts only and nothing is written to out; with
    `each` the files that pass are written and the others only reported. A name that holds a value is masked too, unless
    keep_names. A file that can't be read fails the run. Two names that become equal are told apart by a number."""
    units = named_units(spark, path, suffix)
    found, with_marks = marked(units, chosen, propagate)
    with_marks = with_marks.filter("marks is not null")
    name = F.when(F.col("place") == NAME, F.regexp_replace(F.trim(masked_text()), r"\s+", "_"))
    by_file = with_marks.groupBy("path").agg(F.collect_list(F.struct("place", "marks")).alias("places"), F.max(name).alias("name"))
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(by_file, "path", "left")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, content, places, new in zip(pdf["path"], pdf["content"], pdf["places"], pdf["name"], strict=True):
                marks = {x["place"]: [(m["start"], m["end"], m["tag"]) for m in x["marks"]] for x in (places if places is not None else ())}
                old = PurePosixPath(unquote(source))
                named = f"{new}{old.suffix}" if new and not keep_names else old.name
                yield pd.DataFrame([(source, named, rewritten(suffix or suffix_of(source), bytes(content), marks))], columns=["path", "output", "content"])

    done = written(files.mapInPandas(rewrite, REWRITTEN), "files")
    again = F.row_number().over(Window.partitionBy("output").orderBy("path"))
    outputs = done.select("path", "output").withColumn("n", again).select("path", F.when(F.col("n") == 1, F.col("output")).otherwise(F.regexp_replace("output", r"(\.[^.]*)$", F.concat(F.lit("_"), F.col("n").cast("string"), F.lit("$1")))).alias("output"))
    back = units_in(done, reread).select("path", "surface", "text")
    back = written(back.select(F.col("path").alias("unit"), "surface", F.col("text").alias("masked")), "back")
    values_of = found.join(units.select("unit", "path"), "unit")
    proven = values_of.select(F.col("path").alias("unit"), "entity", "text", "tag")
    unreadable = back.filter(F.col("surface") == UNREADABLE).select(F.col("unit").alias("path"), F.lit("<output unreadable>").alias("value"))
    leaks = left_values(back, proven).select(F.col("unit").alias("path"), "value").union(unreadable)
    patterns = left_patterns(back).select(F.col("unit").alias("path"), "value")
    flags = pattern_flags(back).union(left_names(back, proven)).select(F.col("unit").alias("path"), "value")
    reports = written(report(outputs, values_of.select("path", "entity", "text", "tag", "score", "source"), leaks, patterns, flags, values), "reports")
    clean = F.get_json_object("report", "$.verified") == "true"
    left = reports.filter(~clean).count()
    if verify and left and not each:
        raise MaskingError(f"{left} files still hold values; nothing was written")
    some = done.drop("output").join(outputs, "path")
    if verify and each:
        some = some.join(reports.filter(clean).select("path"), "path", "left_semi")
    some.select("output", "content").foreachPartition(partial(_save, out))
    return reports


#: The surface of a unit that stands for a rewritten file which can't be read.
UNREADABLE = "unreadable"


def reread(name: str, content: bytes) -> Iterator[tuple]:
    """Units of a rewritten file; one that tells so, if it can't be read."""
    try:
        yield from list(any_units(name, content))
    except Exception:  # whatever is wrong with it, it can't be shown to be clean
        yield name, UNREADABLE, 0, 0, "", "", 0


def _save(out: str, rows: Iterator) -> None:
    """Write files under temporary names and move them to their own, on any file system that a URI names."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(out) if "://" in out else (fs.LocalFileSystem(), out)
    system.create_dir(folder, recursive=True)
    for r in rows:
        name = re.sub(r"[/\\]", "_", r["output"])
        part = f"{folder}/.{name}.part"
        try:
            with system.open_output_stream(part) as f:
                f.write(r["content"])
            system.move(part, f"{folder}/{name}")
        except BaseException:
            if system.get_file_info(part).type != fs.FileType.NotFound:
                system.delete_file(part)
            raise
