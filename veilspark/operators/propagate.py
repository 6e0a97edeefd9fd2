"""Values proven in one place found in others: exact, with confusable characters folded, and by spelling."""

from __future__ import annotations

import difflib
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.labels import FACILITY_LABELS, NOT_PROPAGATED, PATIENT_LABELS, PROVIDER_LABELS, TOO_COMMON, UI_NOISE
from veilspark.functions.spans import let
from veilspark.functions.text import TOKEN_EDGES, fold, letters, normalize, token_key
from veilspark.operators.detect import OCR_NOISE, WINDOW, allowed_ranges
from veilspark.operators.policy import Policy
from veilspark.operators.tokens import token_array
from veilspark.sources.scratch import written

RATIO = 0.86
#: The place of units without a number in the order of a job: last.
LAST = (1 << 62) - 1


def _words(entity: Column, text: Column) -> Column:
    """What a finding teaches: each word of a name, else the whole value."""
    return F.when(entity == "PERSON", F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'\-]+"), F.lit(0))).otherwise(F.array(text))


def lexicon(spans: DataFrame, providers: DataFrame | None = None, patients: DataFrame | None = None) -> DataFrame:
    """key, entity, first_ord from spans (ord, entity, text): the first entity that a key had. Dates, ages and places teach
    nothing; names teach each word; keys of one character and everyday words are left out, and so are keys of professionals
    (providers: key, first_doc) that are no patient's (patients: key, first_doc)."""
    some = spans.filter(~F.col("entity").isin(*NOT_PROPAGATED))
    keys = some.select("ord", "entity", F.explode(_words(F.col("entity"), F.col("text"))).alias("w")).withColumn("key", normalize(F.col("w")))
    keys = keys.filter((F.length("key") >= 2) & ~F.col("key").isin(*TOO_COMMON))
    lex = keys.groupBy("key").agg(F.min_by("entity", "ord").alias("entity"), F.min("ord").alias("first_ord"))
    if providers is not None:
        known = providers.join(patients.select("key"), "key", "left_anti") if patients is not None else providers
        lex = lex.join(known.select("key"), "key", "left_anti")
    return lex


def provider_keys(found: DataFrame) -> DataFrame:
    """key, first_doc of values seen under a professional's label: words of names, and whole identifiers."""
    some = found.filter("s.entity = 'PROVIDER'")
    entity = F.when(F.col("s.source") == "structural", F.lit("PERSON")).otherwise(F.lit("ID"))
    text = F.when(entity == "PERSON", F.col("s.text")).otherwise(F.regexp_replace("s.text", OCR_NOISE, ""))
    keys = some.select(F.coalesce("unit", F.lit(LAST)).alias("doc"), F.explode(_words(entity, text)).alias("w"))
    return keys.groupBy(normalize(F.col("w")).alias("key")).agg(F.min("doc").alias("first_doc")).filter("key != ''")


def patient_keys(found: DataFrame) -> DataFrame:
    """key, first_doc of words of names (s, with the tokens before) that stand under a patient's label."""
    named = found.filter((F.col("s.entity") == "PERSON") & F.col("before").rlike("|".join(PATIENT_LABELS)))
    keys = named.select(F.coalesce("unit", F.lit(LAST)).alias("doc"), F.explode(_words(F.lit("PERSON"), F.col("s.text"))).alias("w"))
    return keys.groupBy(normalize(F.col("w")).alias("key")).agg(F.min("doc").alias("first_doc")).filter("length(key) >= 2")


def without_providers(found: DataFrame, providers: DataFrame) -> DataFrame:
    """found (row, unit, s, ...) less what marks professionals, and less names all of whose words, and identifiers that,
    are keys of professionals seen in the same or an earlier unit."""
    known = providers.select(F.col("key").alias("_key"), "first_doc")
    some = found.filter("s.entity != 'PROVIDER'").withColumn("_doc", F.coalesce("unit", F.lit(LAST)))
    words = F.array_distinct(F.transform(_words(F.col("s.entity"), F.when(F.col("s.entity") == "PERSON", F.col("s.text")).otherwise(F.regexp_replace("s.text", OCR_NOISE, ""))), normalize))
    each = some.select("row", "s", "_doc", F.size(words).alias("_n"), F.explode(words).alias("_key"))
    hit = each.join(known, "_key").filter("first_doc <= _doc").groupBy("row", "s", "_n").count().filter("count = _n").select("row", "s")
    return some.join(hit, ["row", "s"], "left_anti").drop("_doc")


def propagated_spans(keyed: DataFrame, lex: DataFrame, chosen: Policy, providers: DataFrame | None, patients: DataFrame | None, seen: bool) -> DataFrame:
    """row, unit and s of tokens of keyed (row, unit, text) that are known values: as they are, with confusable characters
    folded, or, for names, nearly spelt so. lex: key, entity, first_ord. seen: only values first seen in the same or an earlier
    unit count. Tokens inside allowed phrases are left out, and, where professionals are kept, names that are a
    professional's and no patient's, or that stand beside the label of a professional or a facility."""
    text = F.col("text")
    tokens = token_array(text)
    facts = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["g0"].alias("g0"), F.btrim(t["g0"], F.lit(TOKEN_EDGES)).alias("bare")))
    if not chosen.mask_providers:
        facts = let(facts, lambda ts: F.transform(ts, lambda t, i: t.withField("context", F.lower(F.array_join(F.transform(F.slice(ts, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, F.lit(WINDOW))), lambda o: o["g0"]), " ")))))
    if chosen.allowed:
        facts = let(facts, lambda ts: let(allowed_ranges(ts, chosen.allowed), lambda rs: F.filter(ts, lambda t: ~F.exists(rs, lambda r: (r["start"] <= t["start"]) & (t["start"] + F.length(t["g0"]) <= r["end"])))))
    rows = keyed.filter(text.isNotNull()).select("row", "unit", F.coalesce("unit", F.lit(LAST)).alias("_doc"), F.explode(facts).alias("t"))
    rows = rows.withColumn("key", token_key(F.col("t.bare"))).filter("key != ''")
    lex = lex.select("key", "entity", F.col("first_ord.doc").alias("first_doc"))
    known = rows.select("key").distinct()  # words of a corpus are far fewer than its tokens
    exact = lex.select("key", "entity", "first_doc", F.lit(0).alias("how"))
    by_fold = lex.withColumn("folded", fold(F.col("key"))).filter("folded is not null").groupBy("folded").agg(F.min_by("entity", "first_doc").alias("entity"), F.min("first_doc").alias("first_doc"))
    missed = known.filter(~F.col("key").isin(*TOO_COMMON))
    folded = missed.withColumn("folded", fold(F.col("key"))).filter("folded is not null").join(by_fold, "folded").select("key", "entity", "first_doc", F.lit(1).alias("how"))
    fuzzy = similar_words(missed, lex).select("key", F.lit("PERSON").alias("entity"), "first_doc", F.lit(2).alias("how"))
    ways = written(exact.union(folded).union(fuzzy), "ways")
    hits = rows.join(ways, "key")
    if seen:
        hits = hits.filter("first_doc <= _doc")
    first = F.min(F.struct("how", "entity"))
    columns = [F.col(f"t.{c}").alias(c) for c in ("start", "g0", "bare")] + ([] if chosen.mask_providers else [F.col("t.context").alias("context")])
    names = [c for c in ("start", "g0", "bare")] + ([] if chosen.mask_providers else ["context"])
    hits = hits.select("row", "unit", "_doc", "key", "how", "entity", *columns).groupBy("row", "unit", "_doc", "key", *names).agg(first.alias("way")).withColumn("entity", F.col("way.entity"))
    hits = hits.filter(F.col("entity").isin(*chosen.entities) & ~((F.col("entity") == "PERSON") & F.col("key").isin(*UI_NOISE)))
    if not chosen.mask_providers:
        beside = F.col("context").rlike("|".join((*PROVIDER_LABELS, *FACILITY_LABELS)))
        who = lambda t, name: t.select(F.col("key"), F.col("first_doc").alias(name))
        hits = hits.join(who(patients, "_patient"), "key", "left").join(who(providers, "_provider"), "key", "left")
        patient, provider = F.col("_patient") <= F.col("_doc"), F.col("_provider") <= F.col("_doc")
        veto = ~F.coalesce(patient, F.lit(False)) & (F.coalesce(provider, F.lit(False)) | beside)
        hits = hits.filter((F.col("entity") != "PERSON") | ~veto)
    at = F.col("start") + F.length("g0") - F.length(F.ltrim("g0", F.lit(TOKEN_EDGES)))
    return hits.select("row", "unit", F.struct(at.cast("int").alias("start"), (at + F.length("bare")).cast("int").alias("end"), "entity", F.lit(0.75).alias("score"), F.col("bare").alias("text"), F.lit("propagated").alias("source"), F.lit(9).alias("det")).alias("s"))


def exact_matches(tokens: DataFrame, lex: DataFrame) -> DataFrame:
    """tokens (unit, tok, text, ...) whose normalised text is a key, with its entity."""
    return tokens.withColumn("key", token_key(F.col("text"))).join(lex, "key")


def folded_matches(tokens: DataFrame, lex: DataFrame) -> DataFrame:
    """tokens that equal a key once characters that OCR confuses are folded, but don't equal one as they are."""
    keys = lex.withColumn("folded", fold(F.col("key"))).filter("folded is not null").groupBy("folded").agg(F.min_by("entity", "first_ord").alias("entity"), F.min("first_ord").alias("first_ord"))
    missed = tokens.withColumn("key", token_key(F.col("text"))).join(lex.select("key"), "key", "left_anti").filter(~F.col("key").isin(*TOO_COMMON))
    return missed.withColumn("folded", fold(F.col("key"))).join(keys, "folded")


def _edits(n: Column, ratio: float) -> Column:
    """Edits within which a word of up to two letters more than n reaches the ratio: 1 - ratio of both lengths, at most."""
    return F.floor((1 - F.lit(ratio)) * (2 * n + 2) + 1e-9).cast("int")


#: Names of more letters meet words by pieces; what is left of shorter ones without a few letters is not too much to list.
LONGEST = 18


def rests(word: str, ratio: float) -> set[str]:
    """What is left of a word when letters go, in each number that stays in common at least with a word of up to two letters
    more or less that reaches the ratio. The ratio counts letters in common, so two that reach it have such a rest in common."""
    m, out = len(word), set()
    for n in range(max(m - 2, 5), m + 3):
        stay = -(-(m + n - math.floor((1 - ratio) * (m + n) + 1e-9)) // 2)
        if stay <= min(m, n):
            out.add(stay)
    return {"".join(c) for stay in out for c in itertools.combinations(word, stay)}


def meeting(words: DataFrame, keys: DataFrame, ratio: float) -> DataFrame:
    """word, known, first_doc of words (word) and keys (known, n, first_doc) of up to LONGEST letters that have a rest in common."""

    @F.pandas_udf("array<string>")
    def left(w: pd.Series) -> pd.Series:
        return w.map(lambda x: sorted(rests(x, ratio)))

    of = keys.filter(F.col("n") <= LONGEST).select("known", "first_doc", "n", F.explode(left("known")).alias("rest"))
    seen = words.filter(F.length("word") <= LONGEST + 2).select("word", F.explode(left("word")).alias("rest"))
    return seen.join(of, "rest").filter(F.abs(F.length("word") - F.col("n")) <= 2).select("word", "known", "first_doc")


def similar_words(words: DataFrame, lex: DataFrame, ratio: float = RATIO) -> DataFrame:
    """key, word, known, ratio and first_doc for each of words (key) whose letters, five or more, are spelt nearly as the
    word of a name in lex (key, entity, first_doc), or just so.

    Words meet over what both have left without a few letters (see rests). Where a key is long, a pair at the ratio differs by
    d edits at most, so of the d + 1 pieces of a key one stands unchanged in the word, moved by d places at most. Distinct words and keys meet on (key length, piece, letters), an equality join that loses no pair;
    edit distance and the exact ratio are computed for these only. Where the planner knows that the lexicon is small, as
    that of a written one, it broadcasts the pieces of keys and those of words are never shuffled."""
    words = words.withColumn("word", letters(F.col("key"))).filter(F.length("word") >= 5)
    keys = lex.filter((F.col("entity") == "PERSON") & F.col("key").rlike(r"^\p{L}{5,}$")).select(F.col("key").alias("known"), F.length("key").alias("n"), "first_doc")
    distinct = words.select("word").distinct()
    short = meeting(distinct, keys, ratio)
    keys = keys.filter(F.col("n") > LONGEST).withColumn("d", _edits(F.col("n"), ratio)).select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    begin, end = F.floor(F.col("i") * F.col("n") / (F.col("d") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / (F.col("d") + 1)).cast("int")
    pieces = keys.select("known", "first_doc", "n", "i", F.substring("known", begin + 1, end - begin).alias("piece"))
    seen = distinct.filter(F.length("word") > LONGEST - 2).select("word", F.explode(F.sequence(F.greatest(F.length("word") - 2, F.lit(5)), F.length("word") + 2)).alias("n"))
    seen = seen.withColumn("d", _edits(F.col("n"), ratio)).select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i"))
    seen = seen.select("*", F.explode(F.sequence(F.greatest(begin - F.col("d"), F.lit(0)), begin + F.col("d"))).alias("at"))
    seen = seen.select("word", "n", "i", F.substring("word", F.col("at") + 1, end - begin).alias("piece"))
    pairs = seen.join(pieces, ["n", "i", "piece"]).select("word", "known", "first_doc").union(short).distinct().filter(F.levenshtein("word", "known") <= F.floor((1 - F.lit(ratio)) * (F.length("word") + F.length("known")) + 1e-9))

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    near = pairs.withColumn("ratio", similarity("word", "known")).filter(F.col("ratio") >= ratio)
    return words.join(near, "word").select("key", "word", "known", "ratio", "first_doc")


def fuzzy_matches(tokens: DataFrame, lex: DataFrame, ratio: float = RATIO) -> DataFrame:
    """tokens of five letters or more spelt nearly as the word of a name, with that word as key and the best similarity ratio."""
    words = tokens.withColumn("_norm", token_key(F.col("text")))
    near = similar_words(words.select(F.col("_norm").alias("key")).distinct(), lex.select("key", "entity", F.col("first_ord.doc").alias("first_doc")), ratio)
    best = near.groupBy(F.col("key").alias("_norm"), "word").agg(F.max_by("known", "ratio").alias("key"), F.max("ratio").alias("ratio"))
    return words.join(best, "_norm").drop("_norm").withColumn("entity", F.lit("PERSON"))
