"""Fields that a model names: replies taken apart, values found in the text, spans added to those of the rules.

No model is called here. Replies are a table (unit, reply), as any client writes it; what they say is checked, not trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import each_span, merge_spans, span
from veilspark.functions.text import TOKEN_EDGES, canonical_type

from veilspark.operators.tokens import token_array

#: Fields of a reply that count, at most.
MOST_FIELDS = 80
#: What counts as money in a field.
MONEY = r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$|^\$?\d+\.\d{2}$"
#: Entities whose values have a shape: tokens without it are the field's caption.
IDENTIFIERS = ("MEDICAL_RECORD_NUMBER", "ACCOUNT_NUMBER", "HEALTH_PLAN_ID", "CLAIM_NUMBER", "GENERIC_ID")
DEFINITE = (*IDENTIFIERS, "US_SSN", "DATE", "EMAIL_ADDRESS")


def first_json(reply: Column) -> Column:
    """The text from the first brace to the last one of a reply; null where there is none."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def fields_of(replies: DataFrame) -> DataFrame:
    """unit, nth, label, value, owner, entity of replies (unit, reply): at most MOST_FIELDS a reply, in order, those without a
    label left out. Where fields are an object its values count; what is no object, and a reply without fields, gives none."""
    body = F.get_json_object(first_json(F.col("reply")), "$.fields")
    listed = F.from_json(body, "array<string>")
    named = F.map_values(F.from_json(body, "map<string,string>"))
    items = F.slice(F.when(F.ltrim(body).startswith("["), listed).when(F.ltrim(body).startswith("{"), named), 1, MOST_FIELDS)
    rows = replies.select("unit", F.posexplode(items).alias("nth", "item")).filter(F.ltrim("item").startswith("{"))
    of = lambda k: F.trim(F.coalesce(F.get_json_object("item", f"$.{k}"), F.lit("")))
    out = rows.select("unit", "nth", of("label").alias("label"), of("value").alias("value"), F.lower(F.when(of("owner") == "", F.lit("unknown")).otherwise(of("owner"))).alias("owner"), F.coalesce(canonical_type(of("type")), F.lit("")).alias("entity"))
    return out.filter("label != ''")


def shape_score(text: Column, entity: Column) -> Column:
    """How much a token looks like its entity: above 0 it does, below it doesn't."""
    fits = lambda c: F.when(c, F.lit(0.5)).otherwise(F.lit(-0.5))
    out = F.when(entity.isin(*IDENTIFIERS), fits(text.rlike(r"(?i)^(?=.*\d)[A-Z0-9][A-Z0-9\-/]{3,}$")))
    out = out.when(entity == "DATE", fits(text.rlike(r"\d{2}[/-]?\d{2}"))).when(entity == "US_SSN", fits(text.rlike(r"^\d{3}-?\d{2}-?\d{4}$")))
    out = out.when(entity == "EMAIL_ADDRESS", fits(text.contains("@"))).when(entity == "PERSON", fits(text.rlike(r"^\p{L}")))
    return out.when(entity == "LOCATION", F.when(~text.rlike(r"^\d+$") | F.length(text).isin(4, 5), F.lit(0.3)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def grounded(fields: DataFrame, units: DataFrame) -> DataFrame:
    """unit and s, a span for each token of units (unit, text) that holds a field's value; fields may have decision, of which
    `keep` gives none, and no decision masks.

    The words of a value are looked for one after the other, with at most eight other characters between; if they aren't there
    together, less the last one, and so on. Of an entity with a shape only tokens of that shape count, money never does."""
    words = F.regexp_extract_all("value", F.lit(r"[0-9A-Za-z@.]+"), F.lit(0))
    kept = fields.filter("decision is null or decision != 'keep'") if "decision" in fields.columns else fields
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    tries = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.concat(F.lit("(?i)"), F.array_join(F.slice(quoted, F.lit(1), n), "[^0-9A-Za-z]{0,8}")))
    rows = kept.filter(F.size(words) > 0).withColumn("tries", tries).join(units.select("unit", "text"), "unit")
    hits = F.filter(F.transform("tries", lambda p: F.struct(F.call_function("regexp_instr", F.col("text"), p).alias("at"), F.length(F.call_function("regexp_extract", F.col("text"), p, F.lit(0))).alias("n"))), lambda x: x["at"] > 0)
    rows = rows.withColumn("hit", F.get(hits, F.lit(0))).filter("hit is not null")
    touched = F.filter(token_array(F.col("text")), lambda t: (t["start"] < F.col("hit.at") - 1 + F.col("hit.n")) & (t["start"] + F.length(t["g0"]) > F.col("hit.at") - 1))
    bare = lambda t: F.btrim(t["g0"], F.lit(TOKEN_EDGES))
    shaped = F.filter(touched, lambda t: shape_score(bare(t), F.col("entity")) > 0)
    chosen = F.when(F.col("entity") == "", touched).when(F.size(shaped) > 0, shaped).when(F.col("entity").isin(*DEFINITE), F.slice(touched, 1, 0)).otherwise(touched)
    some = F.filter(chosen, lambda t: (bare(t) != "") & ~bare(t).rlike(MONEY))
    entity = F.when(F.col("entity") == "", F.lit("ACCOUNT_NUMBER")).otherwise(F.col("entity"))

    def one(t: Column) -> Column:
        start = t["start"] + F.length(t["g0"]) - F.length(F.ltrim(t["g0"], F.lit(TOKEN_EDGES)))
        return span(start, start + F.length(bare(t)), entity, 0.7, bare(t), "agent", 8)

    return each_span(rows.withColumn("_spans", F.transform(some, one)), "_spans", "unit")


def with_fields(detected: DataFrame, spans: DataFrame) -> DataFrame:
    """detected (unit, spans, ...) with spans (unit, s) added, then merged: what a model names never takes a rule's span away,
    but a longer one of the two wins, as among rules."""
    more = spans.groupBy("unit").agg(F.collect_list("s").alias("_more"))  # the spans of one unit
    both = detected.join(more, "unit", "left")
    return both.withColumn("spans", F.when(F.col("_more").isNull(), F.col("spans")).otherwise(merge_spans(F.concat("spans", "_more")))).drop("_more")


@dataclass(frozen=True)
class ModelSpec:
    """Where a model runs: provider, model, and the base address for a provider that needs one."""

    provider: str
    model: str
    base: str = ""


PROVIDERS = ("ollama", "gemini", "openai-compatible", "openai", "openrouter", "vllm")
PREFIXES = (("gemini", "gemini"), ("gpt-", "openai"), ("o1", "openai"), ("o3", "openai"), ("o4", "openai"))


def model_spec(spec: str) -> ModelSpec:
    """A spec as provider:model, a bare model whose prefix tells a hosted provider, or any other name, which stays local.
    openai-compatible needs model@address, else ValueError."""
    provider, _, model = spec.partition(":")
    provider = provider.casefold()
    if provider not in PROVIDERS:
        provider, model = next((p for prefix, p in PREFIXES if spec.startswith(prefix)), "ollama"), spec
    if provider == "openai-compatible":
        model, _, base = model.partition("@")
        if not base:
            raise ValueError("openai-compatible needs a base address: openai-compatible:MODEL@https://host/v1")
        return ModelSpec(provider, model, base)
    return ModelSpec(provider, model or spec)
