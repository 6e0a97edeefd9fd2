"""Named queries over the standard tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions.spans import each_span
from veilspark.operators import detect as D
from veilspark.operators.geometry import identity_scores, scores
from veilspark.operators.mask import findings_of, mask, mask_columns, marked, masked_text
from veilspark.operators.policy import policy
from veilspark.operators.propagate import exact_matches, folded_matches, fuzzy_matches, lexicon
from veilspark.operators.positioned import words_of_lines
from veilspark.operators.registry import registry
from veilspark.operators.tokens import flat_tokens, token_count
from veilspark.operators.verify import left_patterns, left_values, review_flags
from veilspark.sources.scratch import dealt, written


def units(spark: SparkSession, sf_dir: str, table: str = "documents", heavy: bool = False) -> DataFrame:
    key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[table]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("unit"), F.col(text).alias("text"))
    return (dealt(rows, "unit") if heavy else rows).withColumn("hint", F.lit(""))


def _found(spans: Callable[[Column], Column], entity: str, table: str = "documents", offsets: bool = False) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = each_span(units(spark, sf_dir, table), spans(F.coalesce("text", F.lit(""))), "unit").filter(F.col("s.entity") == entity)
        where = [F.col("s.start").cast("long").alias("start")] if offsets else []
        return s.select(F.col("unit").alias("doc_id"), *where, F.col("s.text").alias("value"))

    return query


def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.select(F.col("unit").alias("doc_id"), token_count(F.col("text")).cast("long").alias("n_tokens"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of tokens, checked in sum: tokens, last end and sum of starts of each document."""
    t = flat_tokens(units(spark, sf_dir))
    return t.groupBy(F.col("unit").alias("doc_id")).agg(F.count("*").alias("n"), F.max("end").cast("long").alias("last_end"), F.sum(F.length("text")).alias("n_chars"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(units(spark, sf_dir, heavy=True)).select(F.col("unit").alias("doc_id"), "masked", F.col("n_spans").cast("long").alias("n_spans"))


def mask_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(units(spark, sf_dir), policy(entities=("EMAIL_ADDRESS",))).select(F.col("unit").alias("doc_id"), "masked")


def tag_registry_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings_of(D.detect(units(spark, sf_dir), policy(entities=("EMAIL_ADDRESS",))))
    return registry(found).select("norm", F.col("index").cast("long").alias("idx"), "tag")


def entity_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of both detectors before the merge, so an IP address inside an e-mail address counts too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.lit("").alias("hint"), "source")
    s = each_span(docs, D.raw_spans_of(policy(entities=("EMAIL_ADDRESS", "IP_ADDRESS"))), "source")
    return s.groupBy("source", F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))


def detected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors after the merge: doc_id, entity, start, end, value."""
    f = findings_of(D.detect(units(spark, sf_dir, heavy=True)))
    return f.select(F.col("unit").alias("doc_id"), "entity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("value"))


def long_digit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).withColumn("masked", F.col("text"))
    return review_flags(u).select(F.col("unit").alias("doc_id"), "value")


def gate_value_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 1 on texts in which nothing was masked: each address that was found is still there."""
    u = units(spark, sf_dir)
    found = findings_of(D.detect(u, policy(entities=("EMAIL_ADDRESS",))))
    return left_values(u.withColumn("masked", F.col("text")), found).select(F.col("unit").alias("doc_id"), "entity", "value")


def gate_value_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 1 on masked texts: nothing is left, so each entity has none. What is looked for, and counted, is all that the
    detectors find in each row, also where another find took its place in the merge and where rows are equal."""
    u = units(spark, sf_dir)
    chosen = policy(entities=("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"))
    _, with_marks = marked(u, chosen)
    found = written(each_span(u, D.raw_spans_of(chosen), "unit").select("unit", "s.entity", "s.text"), "raw")
    left = left_values(with_marks.select("unit", masked_text().alias("masked")), found)
    return found.groupBy("entity").agg(F.count("*").alias("n_found")).join(left.groupBy("entity").agg(F.count("*").alias("n_left")), "entity", "left").select("entity", "n_found", F.coalesce("n_left", F.lit(0)).alias("n_left"))


def gate_pattern_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 2 on texts in which nothing was masked."""
    return left_patterns(units(spark, sf_dir).withColumn("masked", F.col("text"))).select(F.col("unit").alias("doc_id"), "entity", "value")


def _made(spark: SparkSession, sf_dir: str, table: str, unit: str, text: str, hint: str = "''") -> DataFrame:
    """Units made from each row of a table by SQL expressions, for shapes that the documents don't have. Such a table is small and
    lies in few parts, while its texts are heavy on a row; its keys are dealt over the cores before texts are made of them."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return dealt(rows, {"customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey"}[table]).select(F.expr(unit).cast("long").alias("unit"), F.expr(text).alias("text"), F.expr(hint).alias("hint"))


def _spans_in(table: str, unit: str, text: str, hint: str = "''", **chosen) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = findings_of(D.detect(_made(spark, sf_dir, table, unit, text, hint), policy(**chosen)))
        return f.select("unit", "entity", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").alias("value"))

    return query


#: Texts made of the keys of a table, as SQL that both engines read. lpad would cut a key of more than four digits down to four.
CARE = "concat('No ', cast(s_suppkey as string), chr(10), cast(s_suppkey as string), ' Park Lane Drive', chr(10), 'Mercy Medical Center Group', chr(10), 'SSN ', lpad(cast(s_suppkey % 1000 as string), 3, '0'), '-12-', lpad(cast(s_suppkey as string), greatest(4, length(cast(s_suppkey as string))), '0'))"
TICKET = "concat('Case ID: (CS-', cast(c_custkey as string), ') Age: |', cast(c_custkey % 90 + 1 as string), '| Quantity ', cast(c_custkey as string), '9999')"


def date_spans_in_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, "orders", "o_orderkey", "concat('from ', date_format(o_orderdate, 'MM/dd/yyyy'), ' to ', date_format(o_orderdate, 'yyyy-MM-dd'), ' or 13/13/2020')")
    s = each_span(made, D.date_spans(F.col("text")), "unit")
    return s.select("unit", F.col("s.start").cast("long").alias("start"), F.col("s.text").alias("value"))


def mask_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that name a customer without a label, masked since each customer's own row proves the identifier."""
    proven = _made(spark, sf_dir, "customer", "c_custkey", "concat('Customer ID: CUS-', cast(c_custkey as string))")
    bare = _made(spark, sf_dir, "orders", "o_orderkey + 1000000000000", "concat('sent to (cus-', cast(o_custkey as string), '), paid')")
    out = mask(proven.union(bare), policy(entities=("GENERIC_ID",)), propagate="job")
    return out.select("unit", "masked")


def mask_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under null and repeated units, of which some rows are equal: each gets its own marks."""
    made = _made(spark, sf_dir, "orders", "case when o_orderkey % 3 = 0 then null else o_custkey end", "concat('write to user', cast(o_custkey as string), '@example.net or user', cast(o_orderkey % 7 as string), '@example.net')")
    out = mask(made, policy(entities=("EMAIL_ADDRESS",)))
    return out.groupBy("unit", "text", F.regexp_replace("masked", "#[0-9]+", "#").alias("shape"), "n_spans").agg(F.count("*").alias("n")).withColumn("n_spans", F.col("n_spans").cast("long"))


def _word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as boxes, a line a fiftieth of the page high and its length in hundredths wide."""
    rows = units(spark, sf_dir).select("unit", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return rows.filter("trim(text) != ''").select("unit", F.floor(F.col("line") / 50).cast("int").alias("page"), "line", "text", F.lit(0.0).alias("x0"), (F.pmod("line", F.lit(50)) / 50.0).alias("y0"), (F.length("text") / 100.0).alias("x1"), (F.pmod("line", F.lit(50)) / 50.0 + 0.02).alias("y1"))


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines with boxes that tile the line, in sums: the sum of left edges and that of right ones a line."""
    w = words_of_lines(_word_lines(spark, sf_dir))
    return w.groupBy(F.col("unit").alias("doc_id"), F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"), F.round(F.sum("x0"), 6).alias("left"), F.round(F.sum("x1"), 6).alias("right"))


def _boxes(spark: SparkSession, sf_dir: str, dx: str) -> DataFrame:
    """A box for each line item, a unit an order, in rows by the line's number."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    x0 = F.expr(dx).cast("double")
    return rows.select(F.col("l_orderkey").alias("unit"), F.lit(0).alias("page"), F.col("l_linenumber").alias("box"), x0.alias("x0"), (F.col("l_linenumber") / 10.0).alias("y0"), (x0 + 0.2).alias("x1"), (F.col("l_linenumber") / 10.0 + 0.08).alias("y1"))


def box_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of boxes that are moved to the right by hundredths of the quantity."""
    out = scores(_boxes(spark, sf_dir, "0.1"), _boxes(spark, sf_dir, "0.1 + l_quantity / 200"))
    shares = ["area_recall", "area_precision", "hit_recall", "hit_precision"]
    return out.select("unit", "n_truth", "n_drawn", *[F.round(c, 6).alias(c) for c in shares], "n_missed", "n_under_masked")


def identity_scores_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks and lost words where only addresses were masked and the known values are addresses and phone numbers."""
    u = units(spark, sf_dir)
    chosen = policy(entities=("EMAIL_ADDRESS",))
    values = each_span(u, F.concat(D.email_spans(F.col("text")), D.phone_spans(F.col("text"))), "unit").select("unit", F.col("s.text").alias("value"))
    out = identity_scores(u, mask(u, chosen).select("unit", F.col("masked").alias("text")), values)
    return out.filter("n_values > 0").select(F.col("unit").alias("doc_id"), "n_values", "n_leaked", F.round("recall", 6).alias("recall"))


def propagate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents that equal an e-mail address found anywhere, however they are written."""
    u = units(spark, sf_dir, heavy=True)
    lex = written(lexicon(findings_of(D.detect(u, policy(entities=("EMAIL_ADDRESS",))))), "lexicon")
    hits = exact_matches(flat_tokens(u), lex)
    return hits.groupBy(F.col("unit").alias("doc_id"), "key").agg(F.count("*").alias("n"))


def propagate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded and fuzzy variants of values that documents prove: names by surname-first lines, and contact data."""
    u = units(spark, sf_dir, heavy=True)
    lex = written(lexicon(findings_of(D.detect(u, policy(entities=("PERSON", "PHONE_NUMBER", "CREDIT_CARD", "GENERIC_ID"))))), "lexicon")
    t = flat_tokens(u)
    folded = folded_matches(t, lex).select("unit", "tok", "entity", F.lit("folded").alias("how"))
    fuzzy = fuzzy_matches(t, lex).filter(F.col("key") != F.col("word")).select("unit", "tok", "entity", F.lit("fuzzy").alias("how"))
    return folded.union(fuzzy).groupBy(F.col("unit").alias("doc_id"), "entity", "how").agg(F.count("*").alias("n"))


def normalized_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", X.normalize(F.col("p_name")).alias("norm"), X.alnum(F.col("p_brand")).alias("brand_key"))


def mask_customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose header is a label, an address, and one with nothing to mask, under keys that repeat and may be null."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("case when c_custkey % 5 = 0 then null else c_nationkey end").alias("k"), F.expr("concat('MB', cast(c_custkey as string), '5')").alias("member id"), F.expr("concat('c', cast(c_custkey as string), 'x@example.net')").alias("mail"), "c_mktsegment")
    out = mask_columns(c, "k", ["member id", "mail", "c_mktsegment"], policy(entities=("EMAIL_ADDRESS", "HEALTH_PLAN_ID")))
    number = lambda c, name: F.regexp_extract(c, f"^<{name}#([0-9]+)>$", 1).cast("long")
    return out.groupBy("k", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("member id").alias("n_ids"), F.countDistinct("mail").alias("n_mails"), F.count(number("member id", "PLAN")).alias("n_tagged"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detect_email": _found(D.email_spans, "EMAIL_ADDRESS", offsets=True),
    "detect_email_pages": _found(D.email_spans, "EMAIL_ADDRESS", "pages"),
    "detect_phone": _found(D.phone_spans, "PHONE_NUMBER"),
    "detect_ssn": _found(D.ssn_spans, "US_SSN"),
    "detect_ip": _found(D.validated_spans, "IP_ADDRESS"),
    "detect_card": _found(D.validated_spans, "CREDIT_CARD"),
    "detect_dates": _found(D.date_spans, "DATE"),
    "detected_entities": detected_entities,
    "tokens_per_doc": tokens_per_doc,
    "token_lengths": token_lengths,
    "tag_registry_email": tag_registry_email,
    "entity_counts_by_source": entity_counts_by_source,
    "mask_documents": mask_documents,
    "mask_emails": mask_emails,
    "mask_customer_cells": mask_customer_cells,
    "normalized_parts": normalized_parts,
    "long_digit_flags": long_digit_flags,
    "gate_value_leaks": gate_value_leaks,
    "gate_value_clean": gate_value_clean,
    "care_spans": _spans_in("supplier", "s_suppkey", CARE, entities=("LOCATION", "ORGANIZATION", "US_SSN")),
    "ticket_spans": _spans_in("customer", "c_custkey", TICKET, entities=("GENERIC_ID", "AGE")),
    "hint_spans": _spans_in("customer", "c_custkey", "concat('AB', cast(c_custkey as string), '7')", "'Member ID'", entities=("HEALTH_PLAN_ID",)),
    "allowed_phrases": _spans_in("customer", "c_custkey", "concat('Case ID CS-', cast(c_custkey % 3 as string), '000 or Case ID CS-', cast(c_custkey % 3 as string), '111')", entities=("GENERIC_ID",), allowlist=("ID cs-1000 or", "CS-2111")),
    "date_spans_in_orders": date_spans_in_orders,
    "mask_propagated": mask_propagated,
    "mask_repeated_units": mask_repeated_units,
    "word_boxes": word_boxes,
    "box_scores": box_scores,
    "identity_scores_email": identity_scores_email,
    "gate_pattern_leaks": gate_pattern_leaks,
    "propagate_exact": propagate_exact,
    "propagate_variants": propagate_variants,
}

#: RE2 spellings of patterns; where Spark looks around, a group stands for the match.
RE2_EMAIL = r"\b[\w.+-]{2,}@[\w.-]{2,}\b"
RE2_PHONE = r"(?:^|[^0-9])((?:\+?1[-\s.])?\(?[0-9]{3}\)?[-\s.][0-9]{3}[-\s.][0-9]{4})\b"
RE2_SSN = r"\b[0-9]{3}[-\s.][0-9]{2}[-\s.][0-9]{4}\b"
RE2_IP = r"(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?:$|[^0-9.]|\.$|\.[^0-9.])"
#: Over text in which every other character is doubled, so that neighbours don't share the one between.
RE2_CARD = r"(?:^|[^0-9])([0-9](?:(?:  |--)?[0-9]){12,18})(?:$|[^0-9])"
_LETTERS = "length(regexp_replace(split_part(value, '@', 1), '[^\\pL]', '', 'g')) >= 2"
_TRIMMED = "replace(lower(trim(regexp_replace(regexp_replace(value, '[,;|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .,;:#()[]{}/\\''\"<>|*' || chr(92) || chr(9) || chr(10) || chr(13))), 'ß', 'ss')"
_EMAILS = f"""SELECT doc_id, k, value, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(value)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS value, unnest(g[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '{RE2_EMAIL}') AS m, string_split_regex(text, '{RE2_EMAIL}') AS g FROM documents) WHERE len(m) > 0)"""
_REGISTRY = f"SELECT norm, row_number() OVER (ORDER BY d, s) - 1 AS idx FROM (SELECT {_TRIMMED} AS norm, min(doc_id) AS d, min_by(start, doc_id * 1000000 + start) AS s FROM ({_EMAILS}) WHERE {_LETTERS} GROUP BY 1)"
_LUHN = "(SELECT sum(CASE WHEN (len(dg) - i) % 2 = 0 THEN dg[i]::INT ELSE CASE WHEN dg[i]::INT * 2 > 9 THEN dg[i]::INT * 2 - 9 ELSE dg[i]::INT * 2 END END) FROM (SELECT string_split(regexp_replace(value, '[ -]', '', 'g'), '') AS dg), unnest(range(1, len(dg) + 1)) AS r(i)) % 10 = 0"

ORACLES: dict[str, str] = {
    "detect_email": f"SELECT doc_id, start::BIGINT AS start, value FROM ({_EMAILS}) WHERE {_LETTERS}",
    "detect_email_pages": f"SELECT doc_id, value FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{RE2_EMAIL}')) AS value FROM pages) WHERE {_LETTERS}",
    "detect_phone": f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2_PHONE}', 1)) AS value FROM documents) WHERE NOT (contains(value, '.') AND contains(value, ' ')) AND NOT contains(value, ',') AND NOT regexp_matches(trim(value), '^\\(?(800|833|844|855|866|877|888)\\)?[-\\s.]')",
    "detect_ssn": f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2_SSN}')) AS value FROM documents) WHERE NOT (contains(value, '.') AND contains(value, ' '))",
    "detect_ip": f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2_IP}', 1)) AS value FROM documents)",
    "detect_card": f"SELECT doc_id, value FROM (SELECT doc_id, regexp_replace(v, '([ -])[ -]', '\\1', 'g') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '{RE2_CARD}', 1)) AS v FROM documents)) WHERE {_LUHN}",
    "tokens_per_doc": "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_tokens, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents",
    "token_lengths": "SELECT doc_id, len(t)::BIGINT AS n, length(rtrim(text, ' ' || chr(10) || chr(9) || chr(13)))::BIGINT AS last_end, length(array_to_string(t, ''))::BIGINT AS n_chars FROM (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS t FROM documents) WHERE len(t) > 0",
    "tag_registry_email": f"SELECT norm, idx, '<EMAIL#' || idx || '>' AS tag FROM ({_REGISTRY})",
    "entity_counts_by_source": f"SELECT source, entity, count(*) AS n FROM (SELECT doc_id, 'EMAIL_ADDRESS' AS entity FROM ({_EMAILS}) WHERE {_LETTERS} UNION ALL SELECT doc_id, 'IP_ADDRESS' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2_IP}', 1)) FROM documents)) JOIN documents USING (doc_id) GROUP BY 1, 2",
    "mask_emails": f"WITH e AS ({_EMAILS}), r AS ({_REGISTRY}), t AS (SELECT e.doc_id, start, start + length(value) AS stop, '<EMAIL#' || idx || '>' AS tag FROM e JOIN r ON {_TRIMMED} = norm WHERE {_LETTERS}), p AS (SELECT t.doc_id, start, stop, tag, coalesce(lag(stop) OVER (PARTITION BY t.doc_id ORDER BY start), 0) AS before, max(stop) OVER (PARTITION BY t.doc_id) AS last FROM t), m AS (SELECT p.doc_id, string_agg(substr(text, before::INT + 1, (start - before)::INT) || tag, '' ORDER BY start) || substr(any_value(text), max(last)::INT + 1) AS masked FROM p JOIN documents d ON d.doc_id = p.doc_id GROUP BY 1) SELECT doc_id, coalesce(m.masked, text) AS masked FROM documents LEFT JOIN m USING (doc_id)",
    "normalized_parts": "SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name, '[,;|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .,;:#()[]{}/<>|*')) AS norm, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand_key FROM part",
    "long_digit_flags": "SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '<[A-Z_]+#[0-9]+>', ' ', 'g'), '[0-9]+')) AS value FROM documents) WHERE length(value) >= 9",
    "propagate_exact": f"WITH lex AS (SELECT DISTINCT {_TRIMMED} AS key FROM ({_EMAILS}) WHERE {_LETTERS}), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS value FROM documents) SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, {_TRIMMED} AS key FROM t) JOIN lex USING (key) GROUP BY 1, 2",
    "gate_value_leaks": f"SELECT DISTINCT doc_id, 'EMAIL_ADDRESS' AS entity, {_TRIMMED} AS value FROM ({_EMAILS}) WHERE {_LETTERS} AND length({_TRIMMED}) >= 4",
    "gate_value_clean": f"SELECT entity, count(*) AS n_found, 0 AS n_left FROM (SELECT 'EMAIL_ADDRESS' AS entity FROM ({_EMAILS}) WHERE {_LETTERS} UNION ALL SELECT 'PHONE_NUMBER' FROM (PHONE_SQL) UNION ALL SELECT 'CREDIT_CARD' FROM (CARD_SQL)) GROUP BY 1",
    "gate_pattern_leaks": f"SELECT doc_id, 'EMAIL_ADDRESS' AS entity, value FROM ({_EMAILS}) WHERE {_LETTERS} AND length(value) >= 12 UNION ALL SELECT doc_id, 'PHONE_NUMBER', value FROM (PHONE_SQL) UNION ALL SELECT doc_id, 'US_SSN', value FROM (SSN_SQL)",
    "care_spans": "WITH d AS (SELECT s_suppkey::BIGINT AS unit, s_suppkey::VARCHAR AS k FROM supplier), t AS (SELECT *, 'No ' || k || chr(10) AS a, k || ' Park Lane Drive' AS b, 'Mercy Medical Center Group' AS c, lpad((unit % 1000)::VARCHAR, 3, '0') || '-12-' || lpad(k, 4, '0') AS s FROM d) SELECT unit, 'LOCATION' AS entity, length(a) AS start, length(a || b) AS end, b AS value FROM t UNION ALL SELECT unit, 'ORGANIZATION', length(a || b) + 1, length(a || b || c) + 1, c FROM t UNION ALL SELECT unit, 'US_SSN', length(a || b || c) + 6, length(a || b || c || s) + 6, s FROM t WHERE length(k) <= 4",
    "ticket_spans": "WITH d AS (SELECT c_custkey::BIGINT AS unit, 'CS-' || c_custkey AS c, (c_custkey % 90 + 1)::VARCHAR AS g FROM customer) SELECT unit, 'GENERIC_ID' AS entity, 10 AS start, 10 + length(c) AS end, c AS value FROM d UNION ALL SELECT unit, 'AGE', 18 + length(c), 18 + length(c) + length(g), g FROM d",
    "hint_spans": "SELECT c_custkey::BIGINT AS unit, 'HEALTH_PLAN_ID' AS entity, 0 AS start, length('AB' || c_custkey || '7') AS end, 'AB' || c_custkey || '7' AS value FROM customer",
    "allowed_phrases": "SELECT c_custkey::BIGINT AS unit, 'GENERIC_ID' AS entity, s AS start, s + 7 AS end, v AS value FROM (SELECT c_custkey, unnest([8, 27]) AS s, unnest(['CS-' || c_custkey % 3 || '000', 'CS-' || c_custkey % 3 || '111']) AS v FROM customer) WHERE v NOT IN ('CS-1000', 'CS-2111')",
    "date_spans_in_orders": "SELECT o_orderkey::BIGINT AS unit, s AS start, v AS value FROM (SELECT o_orderkey, unnest([5, 19]) AS s, unnest([strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%Y-%m-%d')]) AS v FROM orders)",
    "mask_propagated": "WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE length(c_custkey::VARCHAR) >= 1) SELECT c_custkey::BIGINT AS unit, 'Customer ID: <ID#' || i || '>' AS masked FROM n UNION ALL SELECT o_orderkey + 1000000000000, 'sent to (<ID#' || i || '>), paid' FROM orders JOIN n ON o_custkey = c_custkey",
    "mask_repeated_units": "SELECT unit, text, 'write to <EMAIL#> or <EMAIL#>' AS shape, 2 AS n_spans, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END::BIGINT AS unit, 'write to user' || o_custkey || '@example.net or user' || o_orderkey % 7 || '@example.net' AS text FROM orders) GROUP BY 1, 2",
    "word_boxes": "WITH l AS (SELECT doc_id, i - 1 AS line, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), w AS (SELECT doc_id, line, length(text) AS size, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS word, unnest(g[1:len(m)]) AS gap FROM (SELECT *, regexp_extract_all(text, '\\S+') AS m, string_split_regex(text, '\\S+') AS g FROM l WHERE trim(text) <> '')), e AS (SELECT doc_id, line, k, word, size / 100.0 AS wide, sum(length(gap) + length(word)) OVER o AS stop FROM w WINDOW o AS (PARTITION BY doc_id, line ORDER BY k)), p AS (SELECT *, (stop - length(word)) / 100.0 AS a, stop / 100.0 AS b FROM e), q AS (SELECT doc_id, line, coalesce((lag(b) OVER o + a) / 2, 0.0) AS x0, coalesce((b + lead(a) OVER o) / 2, wide) AS x1 FROM p WINDOW o AS (PARTITION BY doc_id, line ORDER BY k)) SELECT doc_id, line, count(*) AS n, round(sum(x0)::DOUBLE, 6) AS left, round(sum(x1)::DOUBLE, 6) AS right FROM q GROUP BY 1, 2",
    "box_scores": "WITH t AS (SELECT l_orderkey AS unit, l_linenumber AS box, greatest(0.2 - min(l_quantity)::DOUBLE / 200, 0) / 0.2 AS share FROM lineitem GROUP BY 1, 2) SELECT unit, count(*) AS n_truth, count(*) AS n_drawn, round(avg(share), 6) AS area_recall, round(avg(share), 6) AS area_precision, round(avg((share >= 0.5 - 1e-9)::INT), 6) AS hit_recall, round(avg((share > 1e-9)::INT), 6) AS hit_precision, sum((share < 0.5 - 1e-9)::BIGINT) AS n_missed, sum((share < 0.9 - 1e-9)::BIGINT) AS n_under_masked FROM t GROUP BY 1",
    "identity_scores_email": f"WITH v AS (SELECT doc_id, 1 AS mail FROM ({_EMAILS}) WHERE {_LETTERS} UNION ALL SELECT doc_id, 0 FROM (PHONE_SQL)) SELECT doc_id, count(*) AS n_values, count(*) FILTER (WHERE mail = 0) AS n_leaked, round(1 - count(*) FILTER (WHERE mail = 0) / count(*)::DOUBLE, 6) AS recall FROM v GROUP BY 1",
    "mask_customer_cells": "SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k, c_mktsegment, count(*) AS n, count(*) AS n_ids, count(*) AS n_mails, count(*) AS n_tagged FROM customer GROUP BY 1, 2",
}
for _name in ("gate_value_clean", "gate_pattern_leaks", "identity_scores_email"):
    for _mark, _of in (("PHONE_SQL", "detect_phone"), ("CARD_SQL", "detect_card"), ("SSN_SQL", "detect_ssn")):
        ORACLES[_name] = ORACLES[_name].replace(_mark, ORACLES[_of])
