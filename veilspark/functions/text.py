"""Scalar functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.labels import ALIASES, SHORT_NAMES, TOLL_FREE

#: Characters that a value loses at its ends before it is compared.
EDGES = " \t\r\n.,;:#()[]{}/\\'\"<>|*"
TOKEN_EDGES = " \t.,;:()[]{}#<>|'\"/\\“”‘’«»*~^°_-"
#: OCR confusions folded to digits, position by position.
CONFUSED, DIGITS = "OoIiLlSsBbZzGg", "00111155882266"


def normalize(value: Column) -> Column:
    """Separators to blanks, blanks collapsed, edges stripped, case folded."""
    spaced = F.regexp_replace(F.regexp_replace(value, r"[,;|]+", " "), r"(?U)\s+", " ")
    return F.replace(F.lower(F.btrim(spaced, F.lit(EDGES))), F.lit("ß"), F.lit("ss"))


def fold(value: Column) -> Column:
    """Digits of a value of six or more characters that are digits or look like them, with a digit among them; else null."""
    return F.when((F.length(value) >= 6) & value.rlike("[0-9]") & value.rlike(f"^[0-9{CONFUSED}]+$"), F.translate(value, CONFUSED, DIGITS))


def letters(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{L}]", "")


def alnum(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[A-Z_]+#\d+>", " ")


def short_name(entity: Column) -> Column:
    out = entity
    for k, v in SHORT_NAMES.items():
        out = F.when(entity == k, F.lit(v)).otherwise(out)
    return out


def tag(entity: Column, index: Column, template: str = "<{entity}#{index}>", short: bool = True) -> Column:
    """template with {entity}, by its short name or not, and {index} put in."""
    named = F.replace(F.lit(template), F.lit("{entity}"), short_name(entity) if short else entity)
    return F.replace(named, F.lit("{index}"), index.cast("string"))


def canonical_type(name: Column) -> Column:
    """The entity that a free-text type means, else null: a name of an entity that ALIASES has, or an alias. Whatever is no
    letter or apostrophe separates words."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z' ]", " "), " +", " "))
    named = F.replace(F.upper(key), F.lit(" "), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(named.isin(*sorted(set(ALIASES.values()))), named).otherwise(F.element_at(table, key))


def token_key(token: Column) -> Column:
    """normalize of a token, which has no blanks: its edges stripped and separators inside turned to single blanks."""
    spaced = F.translate(token, ",;|", "   ")
    return F.when(spaced.contains(" "), normalize(token)).otherwise(F.replace(F.lower(F.btrim(spaced, F.lit(EDGES))), F.lit("ß"), F.lit("ss")))


def money_shaped(value: Column) -> Column:
    return (value.contains(".") & value.contains(" ")) | value.contains(",")


def toll_free(value: Column) -> Column:
    return F.trim(value).rlike(r"^\(?(" + "|".join(TOLL_FREE) + r")\)?[-\s.]")


def email_shaped(value: Column) -> Column:
    return F.size(F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit(r"(\p{L})"), F.lit(1))) >= 2


def table_noise(entity: Column, value: Column) -> Column:
    """Finds of a re-read table that aren't values: numbers side by side, or short addresses without letters."""
    numbers = entity.isin("US_SSN", "PHONE_NUMBER") & value.contains(".") & value.contains(" ")
    return numbers | ((entity == "EMAIL_ADDRESS") & (~value.rlike(r"\p{L}") | (F.length(value) < 12)))


def looks_read(value: Column) -> Column:
    """Whether a piece of OCR is a word or a number rather than debris."""
    word, digits = F.length(F.regexp_replace(value, r"[^\p{L}\d]", "")), F.length(F.regexp_replace(value, r"\D", ""))
    return (word >= 2) & ((digits == 0) | (digits == word) | (digits * 2 > word))


def is_date(first: Column, second: Column, year: Column) -> Column:
    """Whether (month, day) or (day, month) of a year from 1900 to 2100 is in the calendar."""
    def valid(m: Column, d: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return m.between(1, 12) & (d >= 1) & (d <= last)

    return year.between(1900, 2100) & (valid(first, second) | valid(second, first))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def iban_valid(value: Column) -> Column:
    """ISO 13616: with the first four characters last and letters as numbers from 10, the remainder by 97 is 1."""
    compact = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).cast("int")) == 1
