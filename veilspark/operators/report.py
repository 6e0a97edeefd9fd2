"""What a masking run did, as JSON a file; by default without any value, path or free text of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of findings that may be named in a report.
SOURCES = ("agent", "barcode", "beside-name", "date", "pattern", "presidio", "propagated", "recheck", "spatial", "structural", "validator", "vision")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def report(files: DataFrame, findings: DataFrame, leaks: DataFrame, patterns: DataFrame, review: DataFrame, values: bool = False, trace: DataFrame | None = None) -> DataFrame:
    """path and report (JSON) of files (path, output), from findings (path, entity, text, tag, score, source), leaks and
    patterns (path, value) and review (path, value). Every file has a report; verified means neither leaks nor patterns.

    trace (path, nth, doc_type, step) has what a model's client did, a row a step; the last doc_type counts. Without `values`
    only the number of steps is told.

    Lists of one file are gathered, so they're bounded by a file. Without `values` they are only counted, an unusual entity
    reads CUSTOM and an unusual source custom."""
    entity, source = (F.col("entity"), F.col("source")) if values else (F.when(F.col("entity").rlike("^[A-Z][A-Z0-9_]*$"), F.col("entity")).otherwise("CUSTOM"), F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("custom"))
    one = F.struct(entity.alias("entity"), (F.col("text") if values else F.lit("")).alias("value"), F.col("tag").alias("replacement"), "score", source.alias("source"))
    out = files.join(findings.groupBy("path").agg(F.sort_array(F.collect_list(one)).alias("findings")), "path", "left")
    for name, rows in (("leaked", leaks), ("leaked_patterns", patterns), ("review", review)):
        out = out.join(rows.groupBy("path").agg(F.sort_array(F.collect_set("value")).alias(name)), "path", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    steps = F.array_sort(F.collect_list(F.struct("nth", "step", "doc_type")))
    if trace is not None:
        out = out.join(trace.groupBy("path").agg(steps.alias("_steps"), F.max_by("doc_type", "nth").alias("doc_type")), "path", "left")
    else:
        out = out.withColumns({"_steps": F.array().cast("array<struct<nth:int,step:string,doc_type:string>>"), "doc_type": F.lit(None).cast("string")})
    out = out.withColumn("trace", F.transform(F.coalesce("_steps", F.expr("array()").cast("array<struct<nth:int,step:string,doc_type:string>>")), lambda x: x["step"]))
    shown = (lambda c: F.col(c)) if values else (lambda c: F.array().cast("array<string>").alias(c))
    where = [F.col("path").alias("source"), F.col("output")] if values else [F.concat(F.lit("<input>"), _suffix(F.col("path"))).alias("source"), F.concat(F.lit("<output>"), _suffix(F.col("output"))).alias("output")]
    verified = ((F.size("leaked") == 0) & (F.size("leaked_patterns") == 0)).alias("verified")
    counts = [] if values else [F.size("leaked").alias("leaked_count"), F.size("leaked_patterns").alias("leaked_pattern_count"), F.size("review").alias("review_count"), F.size("trace").alias("trace_count")]
    body = F.struct(*where, F.coalesce("findings", F.array()).alias("findings"), verified, *[shown(c).alias(c) for c in ("leaked", "leaked_patterns", "review", "trace")], *([F.coalesce("doc_type", F.lit("")).alias("doc_type")] if values else []), *counts)
    return out.select("path", F.to_json(body).alias("report"))
