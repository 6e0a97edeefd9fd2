"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import small_batches, staged

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = frozenset("the of and to in is that it for was on with as by this be at are le la les de des et un une du que qui en pour dans der die das und ist ein eine den mit zu von auf für el los las y que del por con una se".encode().split())
SPACES = b" \t\n\r\x0b\x0c"
SPACE_CODES, SYMBOL_CODES = list(SPACES), list(SYMBOLS)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_stop", "n_ends", "n_shout", "n_distinct", "longest")
MIN_WORDS = 50
#: The column that measurements are put in.
MEASURES = "_measures"
#: Word ids above this need exact keys of three words instead of one packed integer.
PACKED = 1 << 20


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found at two or more places."""
    if len(ids) < 4:
        return 0
    x = ids.astype(np.int64)
    if distinct <= PACKED:
        key = (x[:-2] * distinct + x[1:-1]) * distinct + x[2:]
    else:
        pair = np.unique(x[:-1] * distinct + x[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * distinct + x[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for i in range(3):
        inside[i : i + len(again)] |= again
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FIELDS of a whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    index = dict(zip(dict.fromkeys(words), range(n)))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(codes[SPACE_CODES].sum())
    chars = n and len(text) - spaces
    # Ends of sentences, near enough for a rule: marks before a blank or a line end, and at the very end.
    ends = sum(raw.count(m + s) for m in (b".", b"!", b"?") for s in (b" ", b"\n")) + (raw[-1:] in (b".", b"!", b"?"))
    stop = sum(map(STOP_WORDS.__contains__, words))
    return n, chars, int(codes[SYMBOL_CODES].sum()), len(lines) - len(set(lines)), repeated_words(ids, max(1, len(index))), len(lines), int(codes[65:91].sum()), int(codes[97:123].sum()), stop, ends, raw.count(b"!!"), len(index), max(map(len, index), default=0)


def measured(text: str | Column) -> Column:
    """Struct of FIELDS of a text column."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([measure(x.as_py()) for x in texts], np.int64).reshape(-1, len(FIELDS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], list(FIELDS))

    return run(text)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def vote_columns(m: str = MEASURES) -> list[tuple[str, Column]]:
    """Rules in a fixed order: 1 votes good, -1 votes bad, 0 abstains between the two thresholds and where there are no words.
    Each rule can vote both ways, at every length of text. m: the column of measurements."""
    f = {k: F.col(f"{m}.{k}") for k in FIELDS}
    words = f["n_words"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(words == 0, F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    repeat, symbols = _share(f["n_repeat_words"], words), _share(f["n_symbols"], words)
    shout, ends, stop = _share(f["n_shout"], words), _share(f["n_ends"], words), _share(f["n_stop"], words)
    capitals, mean = _share(f["n_upper"], f["n_upper"] + f["n_lower"]), _share(f["word_chars"], words)
    lines, variety = _share(f["n_dup_lines"], f["n_lines"]), _share(f["n_distinct"], F.sqrt(words))
    return [
        ("length", vote(words < 20, words >= 100)),
        ("repeats", vote(repeat > 0.5, repeat < 0.2)),
        ("symbols", vote(symbols > 0.1, symbols < 0.03)),
        ("capitals", vote(capitals > 0.4, capitals < 0.2)),
        ("shouting", vote(shout > 0.1, shout == 0)),
        ("stop_words", vote((stop < 0.03) & (words >= 30), stop >= 0.08)),
        ("sentences", vote((ends < 0.01) & (words >= 80) | (ends > 0.5), ends.between(0.02, 0.25))),
        ("variety", vote((variety < 3) & (words >= 30), variety > 5)),
        ("word_length", vote((mean < 3) | (mean > 12), mean.between(3.5, 9))),
        ("lines", vote((lines > 0.3) & (f["n_lines"] > 3), lines < 0.1)),
    ]


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents. good[j] and bad[j]: how often rule j votes good on good and on bad documents, where it
    votes; so good[j] and 1 - bad[j] are its accuracies in the two classes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, given its votes; abstaining tells nothing."""
        score = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.good, self.bad, strict=True):
            score = score + F.when(v > 0, F.lit(math.log(g / b))).when(v < 0, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-score))


#: Votes in each class that the start of EM counts as, whatever the size of the table: enough to settle a rule that hardly votes.
PSEUDO = 10
START_GOOD, START_BAD, START_PRIOR = 0.95, 0.5, 0.8


def fit_votes(patterns: Iterable[tuple[tuple[int, ...], int]], rounds: int = 500, rules: int = 0) -> VoteModel:
    """EM over distinct vote patterns with their counts: two classes, rules independent within a class, two accuracies a rule.

    It starts from the posterior of a document without, with one and with more bad votes, and each rate counts PSEUDO votes of
    its start besides those cast. No rule votes good more often on bad documents than on good ones, which fixes which class
    is the good one. Several kinds of bad documents make one class, on which each rule is right in part. No patterns: the
    start, for so many rules.
    """
    patterns = sorted(patterns)
    votes = np.array([p for p, _ in patterns], float).reshape(len(patterns), len(patterns[0][0]) if patterns else rules)
    n = np.array([c for _, c in patterns], float)
    against = (votes < 0).sum(1)
    belief = np.where(against == 0, 0.95, np.where(against == 1, 0.5, 0.05))
    up, cast = (votes > 0) * n[:, None], (votes != 0) * n[:, None]
    for _ in range(rounds):
        good = np.clip((belief @ up + PSEUDO * START_GOOD) / (belief @ cast + PSEUDO), 0.01, 0.999)
        bad = np.clip(np.minimum(((1 - belief) @ up + PSEUDO * START_BAD) / ((1 - belief) @ cast + PSEUDO), good), 0.01, 0.99)
        share = float(np.clip((belief @ n + PSEUDO * START_PRIOR) / (n.sum() + PSEUDO), 0.05, 0.95))
        score = math.log(share / (1 - share)) + (votes > 0) @ np.log(good / bad) + (votes < 0) @ np.log((1 - good) / (1 - bad))
        before, belief = belief, 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        if not len(n) or np.abs(belief - before).max() < 1e-10:
            break
    return VoteModel(round(share, 9), tuple(round(float(a), 9) for a in good), tuple(round(float(a), 9) for a in bad))


def vote_patterns(measurements: DataFrame, m: str = MEASURES) -> list[tuple[tuple[int, ...], int]]:
    """Distinct vote patterns of all rows with counts: at most 3 to the number of rules, whatever the input."""
    votes = vote_columns(m)
    names = [f"v{i}" for i in range(len(votes))]
    rows = measurements.select(*[v.alias(k) for k, (_, v) in zip(names, votes, strict=True)]).groupBy(*names).count().collect()
    return [(tuple(r[k] for k in names), r["count"]) for r in rows]


def base_failed(m: str = MEASURES) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def judged(measurements: DataFrame, least: float = 0.5, m: str = MEASURES) -> DataFrame:
    """measurements (a table with a struct column m) with base_failed, quality (the posterior) and kept; columns of these
    names are replaced, others stay. A null or empty text has no words, so it fails the base rules. Equal rows fare alike.
    An empty table gives no rows. Read twice, so it should be a written table."""
    model = fit_votes(vote_patterns(measurements, m), rules=len(vote_columns(m)))
    quality = model.posterior([v for _, v in vote_columns(m)])
    return measurements.withColumns({"base_failed": base_failed(m), "quality": quality, "kept": ~base_failed(m) & (quality >= least)})


def with_measurements(docs: DataFrame, m: str = MEASURES, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all, if null), written, with the measurements of each whole text in the struct column m, which
    replaces one of that name."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != m]
    with small_batches(docs.sparkSession):
        return staged(docs.select(*kept, measured("text").alias(m)), "measured")


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those rejected; rows keep their columns, whatever these are called. Texts are measured once, and written
    with their measures: votes of all rows, then decisions, are taken from these.

    Null and empty texts have no words, so they fail the base rules and go. Repeated rows fare alike. Empty: no rows."""
    m = MEASURES
    while m in docs.columns:
        m += "_"
    rows = with_measurements(docs, m)
    model = fit_votes(vote_patterns(rows, m), rules=len(vote_columns(m)))
    good = model.posterior([v for _, v in vote_columns(m)]) >= least
    return rows.filter(~base_failed(m) & good).select(*docs.columns)
