"""Detectors: from units (unit, text, hint) to spans, in built-in expressions."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions.labels import FACILITY_NOUNS, ID_LABELS, PERSON_LABELS, PROVIDER_LABELS, PROVIDER_SUPPRESSIBLE, STREET_SUFFIXES, TOO_COMMON, UI_NOISE, US_STATES
from veilspark.functions.spans import SPANS, has, let, match_places, merge_spans, no_spans, pattern_spans, span
from veilspark.operators.policy import Policy, policy

#: Shapes of values.
SSN = r"(?U)\b\d{3}[-\s.]\d{2}[-\s.]\d{4}\b"
PHONE = r"(?U)(?<!\d)(?:\+?1[-\s.])?\(?\d{3}\)?[-\s.]\d{3}[-\s.]\d{4}\b"
EMAIL = r"(?U)\b[\w.+-]{2,}@[\w.-]{2,}\b"
DATES = ((r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (1, 2, 3)), (r"(\d{4})-(\d{1,2})-(\d{1,2})", (2, 3, 1)), (r"\b(\d{2})(\d{2})(\d{4})\b", (1, 2, 3)), (r"\b(\d{2})(\d{2})(\d{2})\b", (1, 2, 3)))
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
URL = r"\bhttps?://[^\s<>\"']+"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SURNAME_FIRST = r"\b([A-Z][A-Za-z'\-]{1,20}),\s+([A-Z][A-Za-z'\-]{1,20})(?:\s+([A-Z][A-Za-z'\-]{0,20})\.?)?\b"
WHOLE_NAME = r"^[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3}$"
STREET = r"(?iU)\b\d{1,6}\s+(?:[A-Za-z0-9'.\-]+\s+){0,4}(?:" + "|".join(STREET_SUFFIXES) + r")\b\.?"
CITY = r"(?U)\b[A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){0,3},?\s+(?:" + "|".join(US_STATES) + r")\s+\d{5}(?:-\d{4})?\b"
FACILITY = r"(?U)\b[A-Z][A-Za-z&'\-]+(?:\s+[A-Z][A-Za-z&'\-]+){1,3}\s+(?i:" + "|".join(FACILITY_NOUNS) + r")(?:\s+(?i:institute|center|centre|group|system|inc|llc|llp|corp|pc))?"
#: Shapes of documents' numbers as their issuers publish them; where the shape alone says little, with a word that names them.
ITIN = r"\b9\d{2}[- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b"
DEA = r"\b[ABCDEFGHJKLMPRSTUX][A-Z9]\d{7}\b"
PASSPORT = r"(?i)\bpassport\b(?:\W+[A-Za-z]+){0,3}\W+([A-Z]\d{8}|\d{9})\b"
DRIVER = r"(?i)\b(?:driver'?s?|driving)\s+licen[cs]e\b(?:\W+[A-Za-z]+){0,3}\W+([A-Z]{0,2}\d{4,14})\b"
BANK = r"(?i)\b(?:bank|routing|checking|savings)\b(?:\W+[A-Za-z]+){0,3}\W+(\d{8,17})\b"
COIN = r"\b(?:bc1[02-9ac-hj-np-z]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b"
CANDIDATE = r"(?i)^[A-Z0-9][A-Z0-9._:/\-]*$"
AGE = r"(?i)^(\d{1,3})(?:[-\s]?(?:years?|yrs?)(?:[-\s]?old)?)?$"
AGE_LABEL = r"(?i)\b(?:age|dob|d\.o\.b|yrs|years?\s+old|y/o|birth)\b"
OCR_NOISE = r"[\\|/_^~`·•]"
MAX_AGE = 130
#: What a text with a match of the pattern has in any case; quicker to look for.
NEEDS = {
    SSN: r"re:(?U)\d[-\s.]\d{4}", PHONE: r"re:(?U)\d[-\s.]\d{4}", EMAIL: "@", IPV4: r"re:\d\.\d", URL: "://", CARD: r"re:\d(?:[ -]?\d){12}", IBAN: r"re:[A-Z]{2}\d{2}",
    ITIN: r"re:9\d{2}[- ]\d{2}", DEA: r"re:[A-Z][A-Z9]\d{7}", PASSPORT: r"re:(?i)passport", DRIVER: r"re:(?i)licen[cs]e", BANK: r"re:(?i)bank|routing|checking|savings", COIN: r"re:[13a-km-zA-HJ-NP-Z0-9]{14}",
    SURNAME_FIRST: r"re:[A-Za-z'\-],\s+[A-Z]", STREET: r"re:(?U)\d\s", CITY: r"re:(?U)[A-Z]{2}\s+\d{5}", FACILITY: "",
    DATES[0][0]: r"re:\d[/-]\d", DATES[1][0]: r"re:\d{4}-\d", DATES[2][0]: r"re:\d{8}", DATES[3][0]: r"re:\d{6}",
}
#: A line that is two to four capitalised words and nothing else.
NAME_LINE = r"(?m)^(?U:\s*)" + WHOLE_NAME[1:-1] + r"(?U:\s*)$"
#: A token with a digit; the look-behind keeps the search linear in texts without blanks.
DIGIT_TOKEN = r"(?U)(?<!\S)[^\s0-9]*+[0-9]\S*"
#: Tokens before a candidate in which a label is looked for.
WINDOW = 4


def ssn_spans(text: Column) -> Column:
    return pattern_spans(text, SSN, "US_SSN", 0.9, "pattern", 1, lambda m, _: ~X.money_shaped(m), needs=NEEDS[SSN])


def phone_spans(text: Column) -> Column:
    return pattern_spans(text, PHONE, "PHONE_NUMBER", 0.85, "pattern", 1, lambda m, _: ~X.money_shaped(m) & ~X.toll_free(m), needs=NEEDS[PHONE])


def email_spans(text: Column) -> Column:
    return pattern_spans(text, EMAIL, "EMAIL_ADDRESS", 0.9, "pattern", 1, lambda m, _: X.email_shaped(m), needs=NEEDS[EMAIL])


def date_spans(text: Column) -> Column:
    parts = []
    for i, (pattern, (a, b, y)) in enumerate(DATES):
        number = lambda g: g.try_cast("int")
        short = 2000 if i == 3 else 0
        keep = lambda _, g, a=a, b=b, y=y, short=short: X.is_date(number(g[a - 1]), number(g[b - 1]), number(g[y - 1]) + short)
        parts.append(pattern_spans(text, pattern, "DATE", 0.85, "date", 4, keep, 3, NEEDS[pattern]))
    return F.concat(*parts)


def dea_valid(value: Column) -> Column:
    """The registration number's check digit: odd places, and even places twice, end in the seventh."""
    d = lambda i: F.substring(value, 2 + i, 1).cast("int")
    return (d(1) + d(3) + d(5) + 2 * (d(2) + d(4) + d(6))) % 10 == d(7)


def validated_spans(text: Column, want: set[str] | None = None) -> Column:
    """What a named-entity provider would be asked for and public standards define: IP, URL, card by Luhn, IBAN by mod 97, DEA
    numbers by their check digit, ITIN and coin addresses by their shape, and passports, driver's licenses and bank numbers
    beside a word that names them. want: the entities to look for, all if null."""
    digits = lambda m: F.regexp_replace(m, "[ -]", "")
    kinds = [
        ("IP_ADDRESS", IPV4, 0.6, None, 0),
        ("URL", URL, 0.6, None, 0),
        ("CREDIT_CARD", CARD, 1.0, lambda m, _: X.luhn(digits(m)), 0),
        ("IBAN_CODE", IBAN, 1.0, lambda m, _: X.iban_valid(m), 0),
        ("US_ITIN", ITIN, 0.5, None, 0),
        ("MEDICAL_LICENSE", DEA, 1.0, lambda m, _: dea_valid(m), 0),
        ("US_PASSPORT", PASSPORT, 0.5, None, 1),
        ("US_DRIVER_LICENSE", DRIVER, 0.5, None, 1),
        ("US_BANK_NUMBER", BANK, 0.5, None, 1),
        ("CRYPTO", COIN, 0.5, None, 0),
    ]
    parts = [pattern_spans(text, p, e, score, "validator", 0, keep, needs=NEEDS[p], value=value) for e, p, score, keep, value in kinds if want is None or e in want]
    return F.concat(*parts) if parts else no_spans()


def tail(text: Column, start: Column, reach: int = 1000) -> Column:
    """The WINDOW tokens before a place in a text, lower case; of the last `reach` characters."""
    near = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    return F.lower(F.regexp_extract(near, rf"(?U)(?:\S+\s+){{0,{WINDOW}}}\S*$", 0))


def near_labels(text: Column, start: Column, value: Column, labels: tuple[str, ...]) -> Column:
    """Whether a label is part of the context of any of the first WINDOW tokens of a value: the tokens before it and its own."""
    own = F.lower(F.regexp_extract(value, rf"(?U)^\S+(?:\s+\S+){{0,{WINDOW - 2}}}(?=\s)", 0))
    return F.concat_ws(" ", F.trim(tail(text, start)), own).rlike("|".join(map(_escaped, labels)))


def _structural(line: Column, entity: str | Column, score: float):
    return lambda w: span(w["a"], w["b"], entity, score, F.substring(line, w["a"] + 1, w["b"] - w["a"]), "structural", 2)


def _words_of_span(line: Column, s: Column) -> Column:
    """(start, end) in a line widened to the tokens that it touches."""
    before, after = F.substring(line, F.lit(1), s["start"]), F.substring(line, s["end"] + 1, F.length(line))
    left = F.length(F.regexp_extract(before, r"(?U)(\S*)$", 1))
    right = F.length(F.regexp_extract(after, r"(?U)^(\S*)", 1))
    return F.struct((s["start"] - left).alias("a"), (s["end"] + right).alias("b"))


def structural_spans(text: Column, organizations: bool = False, providers: bool = False) -> Column:
    """Per line: surname first, street, city with state and zip, facility. Whole tokens are covered; names are split in words.
    providers: names beside a professional's label get the entity PROVIDER."""
    lines = F.split(text, "\n", -1)
    kinds = [(SURNAME_FIRST, "PERSON", 0.75), (STREET, "LOCATION", 0.7), (CITY, "LOCATION", 0.7)] + [(FACILITY, "ORGANIZATION", 0.7)] * organizations
    any_of = lambda t: reduce(Column.__or__, [has(t, p, NEEDS[p]) for p, _, _ in kinds])

    def of_line(line: Column, at: Column) -> Column:
        found = []
        for pattern, entity, score in kinds:
            keep = (lambda _, g: ~g[1].isin(*US_STATES)) if entity == "PERSON" else None
            raw = pattern_spans(line, pattern, entity, score, "structural", 2, keep, 3 if entity == "PERSON" else 0, NEEDS[pattern])
            wide = F.transform(raw, lambda s: _words_of_span(line, s))
            if entity != "PERSON":
                found.append(F.transform(wide, _structural(line, entity, score)))
                continue
            value = lambda w: F.substring(line, w["a"] + 1, w["b"] - w["a"])
            named = lambda w: F.when(near_labels(text, at + w["a"], value(w), PROVIDER_LABELS), F.lit("PROVIDER")).otherwise(F.lit("PERSON")) if providers else F.lit("PERSON")
            found.append(F.flatten(F.transform(wide, lambda w: let(named(w), lambda e: F.transform(_split_words(line, w), _structural(line, e, score))))))
        return F.concat(*found)

    begin = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, line: Column) -> Column:
        moved = F.transform(of_line(line, acc["at"]), lambda s: s.withField("start", s["start"] + acc["at"]).withField("end", s["end"] + acc["at"]))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(any_of(line), F.concat(acc["out"], moved.cast(SPANS))).otherwise(acc["out"]).alias("out"))

    return F.when(any_of(text), F.aggregate(lines, begin, step, lambda a: a["out"])).otherwise(no_spans())


def labelled_name_spans(text: Column) -> Column:
    """Names by their label: a line of two to four capitalised words with a name's label among the four tokens before any of
    them (so the line's own words count too), each word a span. The fold carries the last four tokens from line to line."""
    labels = "|".join(map(_escaped, PERSON_LABELS))

    def step(acc: Column, line: Column) -> Column:
        words = F.filter(F.split(line, r"(?U)\s+", -1), lambda w: w != "")
        before = F.concat(acc["tail"], F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
        named = line.rlike(NAME_LINE) & F.lower(F.array_join(before, " ")).rlike(labels) & ~generic_name(line)
        found = F.transform(_split_words(line, F.struct(F.lit(0).alias("a"), F.length(line).alias("b"))), _structural(line, "PERSON", 0.8))
        moved = F.transform(found, lambda s: s.withField("start", s["start"] + acc["at"]).withField("end", s["end"] + acc["at"]))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), _last(F.concat(acc["tail"], words)).alias("tail"), F.when(named, F.concat(acc["out"], moved.cast(SPANS))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("tail"), no_spans().alias("out"))
    return F.when(text.rlike(NAME_LINE) & F.lower(text).rlike(labels), F.aggregate(F.split(text, "\n", -1), begin, step, lambda a: a["out"])).otherwise(no_spans())


def _last(words: Column) -> Column:
    """The last WINDOW of an array of tokens."""
    return F.slice(words, F.greatest(F.size(words) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))


def _split_words(line: Column, w: Column) -> Column:
    """Each word of a stretch by itself, without commas, semicolons and quotes at its end; bare punctuation goes."""
    piece = F.substring(line, w["a"] + 1, w["b"] - w["a"])
    found = F.filter(F.arrays_zip(F.regexp_extract_all(piece, F.lit(r"(?U)\S+"), F.lit(0)).alias("t"), F.split(piece, r"(?U)\S+", -1).alias("gap")), lambda x: x["t"].isNotNull())
    begin = F.struct(w["a"].cast("int").alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        kept = F.length(F.btrim(x["t"], F.lit('" ,;')))
        one = F.array(F.struct(start.alias("a"), (start + kept).alias("b"))).cast("array<struct<a:int,b:int>>")
        return F.struct((start + F.length(x["t"])).cast("int").alias("at"), F.when((kept > 0) & x["t"].rlike(r"[\p{L}\d]"), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, begin, step, lambda a: a["out"])


def _escaped(label: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in label)


def nearest_label(context: Column, hint: Column, providers: bool) -> Column:
    """Entity of the label nearest to a token, from the words before it (joined by blanks, lower case) and the hint, which is
    nearest of all; at the same word the earlier group wins. A provider label that wins gives the entity PROVIDER.

    A label is as far as the word that it ends in, so the words are tried from the last, each with a pattern a group."""
    groups = list(ID_LABELS.items()) + ([("PROVIDER", PROVIDER_LABELS)] if providers else [])
    options = []
    for k in range(-1, WINDOW):
        for entity, labels in groups:
            label = rf"(?<!\w)(?:{'|'.join(map(_escaped, labels))})(?!\w)"
            here = hint.rlike(label) if k < 0 else context.rlike(rf"{label}\S*(?: \S+){{{k}}}$")
            options.append(F.when(here, F.lit(entity)))
    return F.coalesce(*options)


def context_spans(text: Column, hint: Column, chosen: Policy) -> Column:
    """Spans of identifiers and ages, by the four tokens before a candidate (across lines) and the hint. One fold over the
    tokens with a digit carries the offset and the last four tokens, so a text costs time by its length."""
    labels = "|".join(map(_escaped, sorted({*(x for ls in ID_LABELS.values() for x in ls), *(PROVIDER_LABELS if not chosen.mask_providers else ())})))
    found = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(DIGIT_TOKEN), F.lit(0)).alias("t"), F.split(text, DIGIT_TOKEN, -1).alias("gap")), lambda x: x["t"].isNotNull())
    hinted = F.lower(F.coalesce(hint, F.lit("")))

    def entity(v: Column) -> Column:
        years = F.regexp_extract(v["bare"], AGE, 1)
        shaped = F.length(v["clean"]).between(4, 64) & v["clean"].rlike(r"\d") & v["clean"].rlike(CANDIDATE) & ~v["clean"].rlike(r"\d\.\d") & ~v["bare"].rlike(AGE)
        near = F.concat_ws(" ", hinted, v["context"])
        is_age = v["bare"].rlike(AGE) & years.try_cast("int").between(chosen.min_masked_age, MAX_AGE) & (F.lower(v["bare"]).rlike("year|yr") | near.rlike(AGE_LABEL))
        # Most candidates have no label near; one search tells that before each group is looked for.
        return F.when(is_age, F.lit("AGE")).when(shaped & near.rlike(labels), nearest_label(v["context"], hinted, not chosen.mask_providers))

    def step(acc: Column, x: Column) -> Column:
        before = _last(F.concat(acc["tail"], F.filter(F.split(x["gap"], r"(?U)\s+", -1), lambda w: w != "")))
        bare = F.btrim(x["t"], F.lit(X.TOKEN_EDGES))
        facts = F.struct(before.alias("before"), F.lower(F.array_join(before, " ")).alias("context"), bare.alias("bare"), F.regexp_replace(bare, OCR_NOISE, "").alias("clean"), (acc["at"] + F.length(x["gap"])).alias("start"))

        def grown(v: Column) -> Column:
            end = v["start"] + F.length(x["t"])
            first = v["start"] + F.length(x["t"]) - F.length(F.ltrim(x["t"], F.lit(X.TOKEN_EDGES)))
            one = let(entity(v), lambda e: F.when(e.isNotNull(), F.array(span(first, first + F.length(v["bare"]), e, 0.8, v["bare"], "spatial", 3))))
            return F.struct(end.cast("int").alias("at"), _last(F.concat(v["before"], F.array(x["t"]))).alias("tail"), F.concat(acc["out"], F.coalesce(one.cast(SPANS), no_spans())).alias("out"))

        return let(facts, grown)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("tail"), no_spans().alias("out"))
    return F.when(text.rlike("[0-9]"), F.aggregate(found, begin, step, lambda a: a["out"])).otherwise(no_spans())


def generic_name(value: Column) -> Column:
    words = F.array(*[F.lit(w) for w in sorted({*UI_NOISE, *TOO_COMMON})])
    return F.forall(F.split(X.normalize(value), " "), lambda w: F.array_contains(words, w))


def allowed_ranges(tokens: Column, allowed: tuple[str, ...]) -> Column:
    """(start, end) of runs of tokens, an array of (start, g0), that equal a phrase word for word once normalized."""
    by_length: dict[int, list[list[str]]] = {}
    for phrase in allowed:
        by_length.setdefault(len(phrase.split()), []).append(phrase.split())

    def of(ts: Column) -> Column:
        def found(keys: Column) -> Column:
            parts = []
            for n, phrases in sorted(by_length.items()):
                table = F.array(*[F.array(*[F.lit(w) for w in p]) for p in phrases])
                places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(keys) - n, F.lit(0))), lambda i: F.array_contains(table, F.slice(keys, i + 1, F.lit(n))))
                last = lambda i: F.get(ts, i + n - 1)  # noqa: B023, E731
                parts.append(F.transform(places, lambda i: F.struct(F.get(ts, i)["start"].alias("start"), (last(i)["start"] + F.length(last(i)["g0"])).cast("int").alias("end"))))  # noqa: B023
            return F.concat(*parts)

        return let(F.transform(ts, lambda t: X.token_key(t["g0"])), found)

    return let(tokens, of)


def _kept(spans: Column, text: Column, chosen: Policy) -> Column:
    """Spans that the policy's entities, scores and allowlist let pass, and PROVIDER spans where professionals are kept."""
    want = (*chosen.entities, *(() if chosen.mask_providers else ("PROVIDER",)))
    keep = lambda s: s["entity"].isin(*want) & ((s["source"] != "validator") | (s["score"] >= chosen.min_score)) & ~((s["entity"] == "PERSON") & generic_name(s["text"]))
    if not chosen.mask_providers:
        unlabelled = keep
        keep = lambda s: unlabelled(s) & ~((s["source"] == "validator") & s["entity"].isin(*PROVIDER_SUPPRESSIBLE) & near_labels(text, s["start"], s["text"], PROVIDER_LABELS))
    some = F.filter(spans, keep)
    if not chosen.allowed:
        return some
    names = F.array(*[F.lit(a) for a in chosen.allowed])
    outside = lambda ranges: F.filter(some, lambda s: ~F.array_contains(names, X.normalize(s["text"])) & ~F.exists(ranges, lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"])))
    return F.when(F.size(some) > 0, let(allowed_ranges(match_places(text, r"(?U)\S+"), chosen.allowed), outside)).otherwise(some)


@lru_cache(maxsize=64)
def raw_spans_of(chosen: Policy) -> Column:
    """The spans of columns text and hint before any are merged; where professionals are kept, also those of entity PROVIDER,
    which are never masked. Columns don't change, and building this one costs thousands of calls to the JVM, so it's built
    once a policy."""
    text = F.coalesce("text", F.lit(""))
    want = set(chosen.entities)
    if not want:
        return no_spans()
    parts = [validated_spans(text, want)]
    parts += [f(text) for f, e in ((email_spans, "EMAIL_ADDRESS"), (phone_spans, "PHONE_NUMBER"), (ssn_spans, "US_SSN")) if e in want]
    if want & {"PERSON", "LOCATION", "ORGANIZATION"}:
        parts.append(structural_spans(text, "ORGANIZATION" in want, not chosen.mask_providers))
    if "PERSON" in want:
        parts.append(labelled_name_spans(text))
    if "DATE" in want:
        parts.append(date_spans(text))
    if want & {*ID_LABELS, "AGE"}:
        parts.append(context_spans(text, F.col("hint"), chosen))
    return _kept(F.concat(*parts), text, chosen)


@lru_cache(maxsize=64)
def spans_of(chosen: Policy) -> Column:
    """The merged spans of columns text and hint. Of professionals only what the row itself tells is left out."""
    return merge_spans(F.filter(raw_spans_of(chosen), lambda s: s["entity"] != "PROVIDER"))


def detect(units: DataFrame, chosen: Policy | None = None) -> DataFrame:
    """units (unit, text, hint; more columns stay) with spans: all detectors, the policy's filters, then the greedy merge.

    Null and blank texts have no spans. All detectors are one pass over the text, without a shuffle."""
    return units.withColumn("spans", spans_of(chosen or policy()))
