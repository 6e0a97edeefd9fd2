"""Gates: queries over masked units that must return no rows before anything is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.labels import NOT_PROPAGATED
from veilspark.functions.spans import each_span
from veilspark.functions.text import normalize, table_noise, without_tags
from veilspark.operators.detect import date_spans, email_spans, phone_spans, ssn_spans


class MaskingError(RuntimeError):
    """Something sensitive would have been published."""


def _readable(masked: DataFrame, findings: DataFrame) -> DataFrame:
    """unit, entity, value, tag of found values of a unit that its masked text (unit, masked) still has, as whole words.

    Both sides are normalized, tags are left out first, and what stands beside a value may be anything but a letter, a digit
    or an underscore. Units without a number are compared among themselves."""
    tag = F.col("tag") if "tag" in findings.columns else F.lit(None).cast("string").alias("tag")
    needles = findings.filter(~F.col("entity").isin(*NOT_PROPAGATED)).select(F.col("unit").alias("_unit"), "entity", normalize(F.col("text")).alias("value"), tag).filter(F.length("value") >= 4).distinct()
    both = masked.select("unit", normalize(without_tags(F.col("masked"))).alias("_t")).join(needles, F.col("unit").eqNullSafe(F.col("_unit")))
    # Quoted whole, so nothing of a value is taken for a pattern; an end of the quote inside a value is written apart.
    literal = F.concat(F.lit(r"\Q"), F.replace(F.col("value"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    whole = F.rlike(F.col("_t"), F.concat(F.lit(r"(?U)(?<!\w)"), literal, F.lit(r"(?!\w)")))
    return both.filter(F.col("_t").contains(F.col("value"))).filter(whole).select("unit", "entity", "value", "tag")


def _one_word_name() -> Column:
    return (F.col("entity") == "PERSON") & ~F.col("value").contains(" ")


def left_values(masked: DataFrame, findings: DataFrame) -> DataFrame:
    """Gate 1: unit, entity, value for found values (unit, entity, text) that the masked text of the same unit still has.
    Dates, ages and places aren't looked for, nor values under four characters; names of one word are left for review."""
    return _readable(masked, findings).filter(~_one_word_name()).select("unit", "entity", "value").distinct()


def left_names(masked: DataFrame, findings: DataFrame) -> DataFrame:
    """For review: unit and value, a line that names the tag, for names of one word that a masked text still has."""
    said = F.concat(F.lit("name still readable in output: "), F.coalesce("tag", F.lit("<NAME>")))
    return _readable(masked, findings).filter(_one_word_name()).select("unit", said.alias("value")).distinct()


def left_patterns(masked: DataFrame) -> DataFrame:
    """Gate 2, whatever the policy: numbers, addresses and dates with separators that fresh detectors find in masked text."""
    text = without_tags(F.coalesce("masked", F.lit("")))
    fresh = F.concat(ssn_spans(text), phone_spans(text), email_spans(text), F.filter(date_spans(text), lambda s: s["text"].rlike("[/-]")))
    found = each_span(masked, fresh, "unit")
    return found.select("unit", "s.entity", F.col("s.text").alias("value")).filter(~table_noise(F.col("entity"), F.col("value")))


def review_flags(masked: DataFrame) -> DataFrame:
    """For review, not a leak: bare runs of nine digits or more."""
    text = without_tags(F.coalesce("masked", F.lit("")))
    return masked.select("unit", F.explode(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{9,}(?!\d)"), F.lit(0))).alias("value"))


def pattern_flags(masked: DataFrame) -> DataFrame:
    """For review: unit and value, a line each for dates without separators, long runs of digits, and shapes that gate 2 took
    for noise of a table. A line names what was found, save that of a run of digits, which tells its length."""
    text = without_tags(F.coalesce("masked", F.lit("")))
    bare = F.filter(date_spans(text), lambda s: ~s["text"].rlike("[/-]"))
    dates = F.transform(bare, lambda s: F.concat(F.lit("unmasked date-shaped run: "), s["text"]))
    noise = F.filter(F.concat(ssn_spans(text), phone_spans(text), email_spans(text)), lambda s: table_noise(s["entity"], s["text"]))
    noises = F.transform(noise, lambda s: F.concat(s["entity"], F.lit(" shape suppressed as table noise: "), s["text"]))
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{9,}(?!\d)"), F.lit(0)), lambda r: F.concat(F.lit("unmasked "), F.length(r).cast("string"), F.lit("-digit run in output")))
    return masked.select("unit", F.explode(F.array_distinct(F.concat(dates, runs, noises))).alias("value"))


def seeds_of(patterns: DataFrame) -> DataFrame:
    """key, entity, first_ord for the lexicon of a second run, from what gate 2 found (unit, entity, value): a date stays a date,
    any other shape counts as an account number."""
    entity = F.when(F.col("value").rlike(r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$"), F.lit("DATE")).otherwise(F.lit("ACCOUNT_NUMBER"))
    start = F.struct(F.lit(-1).cast("long").alias("doc"), F.lit(0).alias("start"), F.lit(0).alias("det"))
    return patterns.select(normalize(F.col("value")).alias("key"), entity.alias("entity"), start.alias("first_ord")).filter("length(key) >= 2").distinct()


def publish(masked: DataFrame, findings: DataFrame, path: str, gates: bool = True) -> None:
    """Write masked units to path if both gates are clean; else raise MaskingError with counts and no values."""
    if gates:
        n, m = left_values(masked, findings).count(), left_patterns(masked).count()
        if n or m:
            raise MaskingError(f"{n} values and {m} patterns are left; nothing was written")
    masked.write.mode("errorifexists").parquet(path)
