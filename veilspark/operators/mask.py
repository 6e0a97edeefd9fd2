"""From units to masked units: detect, carry proven values over, number, splice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import each_span, merge_spans, splice
from veilspark.functions.text import normalize
from veilspark.operators.detect import raw_spans_of, spans_of, tail
from veilspark.operators.policy import Policy, policy
from veilspark.operators.propagate import LAST, lexicon, patient_keys, propagated_spans, provider_keys, without_providers
from veilspark.operators.registry import registry
from veilspark.sources.scratch import written


def row_key() -> Column:
    """128 bits of unit, hint and text, by which a row is told from others. Rows equal in all three have equal findings."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(F.col("unit").cast("string")), part(F.col("hint")), part(F.col("text")))))


def ordered(start: Column | str = "s.start", det: Column | str = "s.det") -> Column:
    """The place of a finding in a job: unit, start, detector. Units without a number come last."""
    place = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(F.coalesce("unit", F.lit(LAST)).cast("long").alias("doc"), place(start).alias("start"), place(det).alias("det"))


def findings_of(detected: DataFrame) -> DataFrame:
    """A row for each span of detected units: unit, ord, and the span's fields."""
    return each_span(detected, "spans", "unit").select("unit", ordered().alias("ord"), "s.*")


#: A detector of one's own: units (unit, text, hint, ...) to the same with spans, as functions.spans.SPANS.
Detector = Callable[[DataFrame], DataFrame]


def job_findings(units: DataFrame, chosen: Policy | None = None, propagate: str | None = None, detector: Detector | None = None) -> DataFrame:
    """Findings of a job, written: row, unit, ord and the span's fields. Equal rows of units have theirs once.

    propagate: null leaves each row to itself; "job" also finds every occurrence of values that any row proves; "seen" only of
    values that rows of the same or an earlier unit prove. Where professionals are kept, names and identifiers that were seen
    under a professional's label, in the same or an earlier unit, are dropped. detector takes the place of the detectors here.

    Texts are read once by the detectors and, with propagate, once more as tokens; what is joined and merged between are the
    findings, which are far smaller."""
    chosen = chosen or policy()
    columns = ["row", "unit", "s"]
    keyed = units.withColumn("row", row_key())
    keep_professionals = not chosen.mask_providers
    # The tokens before a finding tell whether its label is a patient's; they are looked up only where that counts.
    before = [F.lit("").alias("before")] if not keep_professionals else [tail(F.coalesce("text", F.lit("")), F.col("s.start")).alias("before")]
    spans = raw_spans_of(chosen) if keep_professionals else spans_of(chosen)
    detected = keyed.withColumn("_spans", spans) if detector is None else detector(keyed).withColumnRenamed("spans", "_spans")
    seen = each_span(detected, "_spans", "row", "unit", *(["text"] if keep_professionals else []))
    found = written(seen.select("row", "unit", "s", *before).dropDuplicates(["row", "s"]), "observed")
    if keep_professionals:
        providers = written(provider_keys(found), "providers")
        found = written(merged_by_row(without_providers(found, providers)), "proven")
    else:
        providers = None
    if propagate:
        patients = patient_keys(found) if keep_professionals else None
        lex = written(lexicon(found.select(ordered().alias("ord"), "s.entity", "s.text"), providers, patients), "lexicon")
        more = propagated_spans(keyed, lex, chosen, providers, patients, propagate == "seen")
        found = written(merged_by_row(found.select(*columns).union(more.select(*columns))), "found")
    return found.select("row", "unit", ordered().alias("ord"), "s.*")


def merged_by_row(found: DataFrame) -> DataFrame:
    """found (row, unit, s; more columns stay) with the spans of each row merged: what overlaps a chosen one goes."""
    chosen = found.groupBy("row").agg(merge_spans(F.collect_set("s")).alias("chosen"))  # the spans of one row
    return found.join(chosen.select("row", F.explode("chosen").alias("s")), ["row", "s"], "left_semi")


def marked(units: DataFrame, chosen: Policy | None = None, propagate: str | None = None, detector: Detector | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (row, unit, ord, the span's fields, tag) and units with marks (start, end, tag in order; null for none).

    Findings are written first, as the numbering reads them several times. Tags are numbered in the order of units; a key of
    unit, hint and text brings them back, so units without a number and units that repeat one, with the same text or
    another, each get their own marks."""
    chosen = chosen or policy()
    found = job_findings(units, chosen, propagate, detector)
    tags = registry(found, chosen.tag_template, chosen.short_names).select("entity", "norm", "tag")
    tagged = found.withColumn("norm", normalize(F.col("text"))).join(tags, ["entity", "norm"])
    marks = tagged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("marks"))
    return tagged, units.withColumn("_row", row_key()).join(marks.withColumnRenamed("row", "_row"), "_row", "left").drop("_row")


def masked_text(text: str = "text", marks: str = "marks") -> Column:
    return F.when(F.col(marks).isNotNull(), splice(F.col(text), F.col(marks))).otherwise(F.col(text))


def mask(units: DataFrame, chosen: Policy | None = None, propagate: str | None = None, detector: Detector | None = None) -> DataFrame:
    """units (unit, text, hint; more columns stay) with masked, n_spans: each value replaced by its tag; null texts stay null.
    unit is a whole number or null; it may repeat. propagate, detector: see job_findings."""
    _, out = marked(units, chosen, propagate, detector)
    return out.select(*units.columns, masked_text().alias("masked"), F.coalesce(F.size("marks"), F.lit(0)).alias("n_spans"))


def mask_columns(df: DataFrame, key: str, columns: list[str], chosen: Policy | None = None, propagate: str | None = None, normalize_headers: bool = False) -> DataFrame:
    """df with string columns masked, each column's name being the hint for its cells, as a table's header is.

    Tags are numbered in the order of key, which may be of any type that sorts, null and repeated; rows of one key keep each
    their own cells. normalize_headers: underscores in names count as blanks, so that customer_id is the label customer id."""
    rows = written(df.orderBy(key).withColumn("_unit", F.monotonically_increasing_id()), "rows")
    hint = lambda c: c.replace("_", " ") if normalize_headers else c
    cells = rows.select("_unit", F.posexplode(F.array(*[F.struct(F.lit(hint(c)).alias("hint"), F.col(f"`{c}`").alias("text")) for c in columns])).alias("_col", "x"))
    units = cells.select((F.col("_unit") * len(columns) + F.col("_col")).alias("unit"), "_unit", "_col", "x.hint", "x.text")
    _, done = marked(units, chosen, propagate)
    marks = done.filter("marks is not null").groupBy("_unit").agg(F.collect_list(F.struct("_col", "marks")).alias("_m"))  # the cells of one row
    out = rows.join(marks, "_unit", "left")
    of = lambda i: F.get(F.filter("_m", lambda m: m["_col"] == i), F.lit(0))["marks"]
    masked = {c: F.when(of(i).isNotNull(), splice(F.col(f"`{c}`"), of(i))).otherwise(F.col(f"`{c}`")) for i, c in enumerate(columns)}
    return out.select(*[masked[c].alias(c) if c in masked else F.col(f"`{c}`") for c in df.columns])
