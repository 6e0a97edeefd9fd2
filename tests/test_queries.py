"""Queries against their SQL, on rows that the standard tables of small sizes don't have."""

import difflib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilspark.operators.positioned import words_of_lines
from veilspark.operators.propagate import RATIO, meeting, similar_words
from veilspark.operators.tokens import flat_tokens
from veilspark.plans.catalog import ORACLES, QUERIES
from veilspark.sources.scratch import dealt


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables written to folder."""
    with duckdb.connect() as con:
        for t, columns in tables.items():
            pq.write_table(pa.table(columns), folder / f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        out = con.execute(ORACLES[name])
        names = [c[0] for c in out.description]
        want = Counter(out.fetchall())
    return Counter(tuple(r[c] for c in names) for r in QUERIES[name](spark, str(folder)).collect()), want


def documents(*texts):
    return {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "source": ["a"] * len(texts)}


def test_care_spans_of_long_keys(spark, tmp_path):
    got, want = both(spark, tmp_path, "care_spans", supplier={"s_suppkey": pa.array([7, 1234, 12345, 123456], pa.int64())})
    assert got == want and sum(want.values()) == 10


#: One of ten last digits makes a card number of the end of the phone number and what follows it.
CROSSED = [f"call +1 (555) 123-4567 12345{d} now" for d in range(10)]


@pytest.mark.parametrize("name, texts", [("entity_counts_by_source", ["from root@10.0.0.1 or 10.0.0.2"]), ("gate_value_clean", CROSSED)])
def test_finds_that_overlap_are_counted(spark, tmp_path, name, texts):
    got, want = both(spark, tmp_path, name, documents=documents(*texts))
    assert got == want and len(want) == 2


def test_addresses_that_share_a_blank(spark, tmp_path):
    """The SQL takes the blank as the end of the first address, which leaves the second none to begin after."""
    got, want = both(spark, tmp_path, "detect_ip", documents=documents("1.2.3.4 5.6.7.8", "at 9.9.9.9... so"))
    assert not want - got
    assert got == Counter({(0, "1.2.3.4"): 1, (0, "5.6.7.8"): 1, (1, "9.9.9.9"): 1})


def test_heavy_queries_run_on_all_cores(spark, tmp_path):
    """A table in one file, and one in more splits than it has row groups, are dealt over the cores."""
    both(spark, tmp_path, "ticket_spans", customer={"c_custkey": pa.array(range(4000), pa.int64())})
    cores = spark.sparkContext.defaultParallelism
    assert QUERIES["ticket_spans"](spark, str(tmp_path)).rdd.getNumPartitions() >= cores
    one = spark.range(4000).repartition(1).union(spark.range(0, 0, 1, 2 * cores))
    assert dealt(one, "id").rdd.glom().map(len).max() < 2000
    even = spark.range(0, 4000, 1, 2 * cores)
    assert dealt(even, "id") is even


def test_tokens_are_those_of_the_pattern(spark):
    """Over bytes of many rows at once, without a row-by-row fold and without a shuffle."""
    rng = random.Random(3)
    texts = [None, "", " ", *("".join(rng.choices("ab\n\t \x1c  　\u0085é漢😀.", k=rng.randrange(1, 40))) for _ in range(300))]
    blank = re.compile(r"[^\t-\r \x85\xa0  -     　]+")
    want = [(i, n, (t or "")[: m.start()].count("\n"), m.start(), m.end(), m[0]) for i, t in enumerate(texts) for n, m in enumerate(blank.finditer(t or ""))]
    df = flat_tokens(spark.createDataFrame(list(enumerate(texts)), "unit long, text string").repartition(2))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == want


def test_words_of_lines_are_not_shuffled(spark):
    lines = spark.createDataFrame([(1, 0, 0, "ab  c", 0.0, 0.0, 0.5, 0.1), (1, 0, 0, "ab  c", 0.0, 0.0, 0.5, 0.1), (2, 0, 1, "x", None, 0.0, None, 0.1), (2, 0, 2, None, 0.0, 0.0, 1.0, 0.1)], "unit long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    words = words_of_lines(lines)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["unit"], r["line"], r["nth"], r["text"], r["x0"], r["x1"]) for r in words.collect()), key=str)
    assert got == [(1, 0, 0, "ab", 0.0, pytest.approx(0.3)), (1, 0, 0, "ab", 0.0, pytest.approx(0.3)), (1, 0, 1, "c", pytest.approx(0.3), 0.5), (1, 0, 1, "c", pytest.approx(0.3), 0.5), (2, 1, 0, "x", None, None)]


def test_similar_words_are_those_of_brute_force(spark):
    """All pairs at the ratio, from few that meet: words that have three letters in a row in common don't."""
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abcde", k=rng.randrange(5, 23))) for _ in range(150)})
    words = set(names)
    for n in names * 4:
        w = list(n)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(["", "x", w[at] + "y"])
        words.add("".join(w))
    words = sorted(w for w in words if len(w) >= 5)
    lex = spark.createDataFrame([(n, "PERSON", 1) for n in names], "key string, entity string, first_doc long")
    known = spark.createDataFrame([(w,) for w in words], "key string")
    want = {(w, n) for w in words for n in names if abs(len(w) - len(n)) <= 2 and difflib.SequenceMatcher(None, w, n).ratio() >= RATIO}
    got = [(r["word"], r["known"]) for r in similar_words(known, lex).collect()]
    assert set(got) == want and len(got) == len(want)
    short = meeting(known.select(F.col("key").alias("word")), lex.select(F.col("key").alias("known"), F.length("key").alias("n"), "first_doc"), RATIO)
    assert short.distinct().count() <= 2 * len(want)
