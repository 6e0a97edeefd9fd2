import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions.spans import merge_spans
from veilspark.operators.context import spatial_context
from veilspark.operators.detect import detect
from veilspark.operators.geometry import not_covered, not_overlapping
from veilspark.operators.mask import findings_of, mask, mask_columns
from veilspark.operators.policy import policy
from veilspark.operators.propagate import exact_matches, folded_matches, fuzzy_matches, lexicon
from veilspark.operators.registry import registry
from veilspark.operators.tokens import assign_lines, flat_tokens, segments
from veilspark.operators.verify import MaskingError, left_names, left_patterns, left_values, publish, review_flags
from veilspark.sources.files import csv_lines, file_units

NOTE = "Customer support follow-up\n\nCase ID: CS-48271\nCustomer: Mira Calder\nCustomer ID: CUS-4827-9136\nEmail: mira.calder@example.net\nPhone: 202-555-0147\nThe customer asked to move the delivery window to 12/31/2026."


def units(spark, *texts):
    return spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "unit long, text string, hint string")


def found(spark, text, hint="", **kw):
    df = spark.createDataFrame([(0, text, hint)], "unit long, text string, hint string")
    return [(r["entity"], r["text"]) for r in findings_of(detect(df, policy(**kw))).orderBy("start").collect()]


def test_note_is_masked(spark):
    out = mask(units(spark, NOTE)).first()["masked"].split("\n")
    assert out[2] == "Case ID: <ID#0>" and out[4] == "Customer ID: <ID#1>"
    assert out[5] == "Email: <EMAIL#0>" and out[6] == "Phone: <PHONE#0>"
    assert out[7].endswith("window to <DATE#0>.") and out[0] == "Customer support follow-up"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Reference ID REF-5509-ZINC", [("GENERIC_ID", "REF-5509-ZINC")]),
        ("Quantity 48279136", []),
        ("Account number then Customer ID CUS-8172-A4", [("GENERIC_ID", "CUS-8172-A4")]),
        ("Age 46", [("AGE", "46")]),
        ("12/31/2026 31/12/2026 02/30/2026", [("DATE", "12/31/2026"), ("DATE", "31/12/2026")]),
        ("SSN 000-00-0000", [("US_SSN", "000-00-0000")]),
        ("Total 2,080.10 0730", []),
        ("CALDER, MIRA Q.", [("PERSON", "CALDER"), ("PERSON", "MIRA"), ("PERSON", "Q.")]),
        ("call 800-555-0147", []),
        ("Customer name:\nMira Calder", [("PERSON", "Mira"), ("PERSON", "Calder")]),
        ("Shipping window\nMira Calder", []),
        ("Full Name a b c d e\n  Mira  Calder ", []),
        ("Email\nCustomer Support", []),
        ("a@b mira.c@example.net", [("EMAIL_ADDRESS", "mira.c@example.net")]),
        ("4111 1111 1111 1111 4111 1111 1111 1112", [("CREDIT_CARD", "4111 1111 1111 1111")]),
        ("GB82 WEST 1234 5698 7654 32", [("IBAN_CODE", "GB82 WEST 1234 5698 7654 32")]),
        ("", []),
        ("   ", []),
    ],
)
def test_detectors(spark, text, expected):
    assert found(spark, text) == expected


def test_profiles_and_choices(spark):
    assert found(spark, "Age 46", profile="hipaa-safe-harbor") == []
    assert found(spark, "mira.calder@example.net", entities=()) == []
    assert found(spark, "CUS-4827", hint="customer id") == [("GENERIC_ID", "CUS-4827")]
    assert found(spark, "a.b@example.net", allowlist=("A.B@example.net",)) == []
    with pytest.raises(ValueError):
        policy("unknown")


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(0, None, ""), (1, "ab@example.net", None)], "unit long, text string, hint string")
    assert [r["masked"] for r in mask(df).orderBy("unit").collect()] == [None, "<EMAIL#0>"]


def test_merge_prefers_long_then_score(spark):
    rows = [(10, 21, "PHONE_NUMBER", 0.4, "x", "p", 1), (10, 21, "US_SSN", 0.85, "x", "p", 1), (30, 50, "EMAIL_ADDRESS", 0.9, "x", "p", 1), (50, 55, "AGE", 0.8, "x", "p", 1)]
    df = spark.createDataFrame([(rows,)], "s array<struct<start:int,end:int,entity:string,score:double,text:string,source:string,det:int>>")
    assert [s["entity"] for s in df.select(merge_spans(F.col("s")).alias("m")).first()["m"]] == ["US_SSN", "EMAIL_ADDRESS", "AGE"]


def test_registry_numbers_in_order_of_sight(spark):
    rows = [((0, 0, 1), "PERSON", "CALDER,"), ((0, 9, 1), "PERSON", "Calder"), ((1, 0, 1), "PERSON", "MIRA"), ((2, 1, 1), "GENERIC_ID", "CUS-1")]
    df = spark.createDataFrame(rows, "ord struct<doc:long,start:int,det:int>, entity string, text string")
    assert {(r["norm"], r["tag"]) for r in registry(df).collect()} == {("calder", "<NAME#0>"), ("mira", "<NAME#1>"), ("cus-1", "<ID#0>")}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("(MIRA.CALDER@EXAMPLE.NET)", "73186o104", "total", "see <NAME#0> there")], "a string, b string, c string, d string")
    r = df.select(X.normalize(F.col("a")), X.fold(F.col("b")), X.fold(F.col("c")), X.without_tags(F.col("d")), X.canonical_type(F.lit("Employee_ID")), X.looks_read(F.lit("CUS48279136")), X.looks_read(F.lit("7"))).first()
    assert list(r) == ["mira.calder@example.net", "731860104", None, "see   there", "GENERIC_ID", True, False]


def test_tokens(spark):
    got = [tuple(r)[1:] for r in flat_tokens(units(spark, " ab\n\ncd e ")).orderBy("tok").collect()]
    assert got == [(0, 0, 1, 3, "ab"), (1, 2, 5, 7, "cd"), (2, 2, 8, 9, "e")]


def test_propagation(spark):
    f = spark.createDataFrame([((0, 0, 1), "PERSON", "CALDER"), ((0, 9, 1), "GENERIC_ID", "731860104"), ((0, 20, 1), "DATE", "12/31/2026")], "ord struct<doc:long,start:int,det:int>, entity string, text string")
    lex, t = lexicon(f), flat_tokens(units(spark, "Calder Caldor 7318601O4 total 12/31/2026"))
    assert [r["text"] for r in exact_matches(t, lex).collect()] == ["Calder"]
    assert [r["text"] for r in folded_matches(t, lex).collect()] == ["7318601O4"]
    assert fuzzy_matches(t, lex).filter("key != word").collect() == []
    assert [r["text"] for r in fuzzy_matches(flat_tokens(units(spark, "Montgomeri")), lexicon(f.withColumn("text", F.lit("Montgomery")))).collect()] == ["Montgomeri"]


def test_gates(spark, tmp_path):
    m = spark.createDataFrame([(0, "SSN 000-00-0000 and 10/03/2026 mira <NAME#0> 123456789")], "unit long, masked string")
    f = spark.createDataFrame([(0, "PERSON", "MIRA"), (0, "GENERIC_ID", "(and)"), (0, "GENERIC_ID", "10/03")], "unit long, entity string, text string")
    assert {r["value"] for r in left_patterns(m).collect()} == {"000-00-0000", "10/03/2026"}
    assert [r["value"] for r in left_values(m, f).collect()] == ["10/03"]  # a name of one word is for review, and no leak
    assert [r["value"] for r in left_names(m, f).collect()] == ["name still readable in output: <NAME>"]
    assert [r["value"] for r in review_flags(m).collect()] == ["123456789"]
    with pytest.raises(MaskingError):
        publish(m, f, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_positioned_tokens(spark):
    rows = [(0, 0, 0, 0.10, 0.10, 0.18, 0.12, "Customer"), (0, 0, 1, 0.19, 0.10, 0.22, 0.12, "ID"), (0, 0, 2, 0.10, 0.13, 0.25, 0.15, "CUS-4827-9136"), (0, 0, 3, 0.62, 0.101, 0.75, 0.12, "Status")]
    t = assign_lines(spark.createDataFrame(rows, "unit long, page int, tok int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert [r["line"] for r in t.orderBy("tok").collect()] == [0, 0, 1, 0]
    assert spatial_context(t).filter("tok = 2").first()["context"] == "customer id"
    assert [r["seg"] for r in segments(t.withColumn("height", F.col("y1") - F.col("y0"))).orderBy("tok").collect()] == [0, 0, 0, 1]
    box = t.filter("tok < 2")
    assert not_overlapping(t, box).count() == 2
    assert not_covered(box.withColumn("span", F.lit(1)), box).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('customer id,email\nCUS-4827-9136,"x, ab@example.net"\n1,2,3\n')
    cells = file_units(spark, str(tmp_path / "a.csv"), ".csv")
    assert {(r["row"], r["col"], r["hint"]) for r in cells.collect()} == {(0, 0, ""), (0, 1, ""), (1, 0, "customer id"), (1, 1, "email"), (2, 0, "customer id"), (2, 1, "email"), (2, 2, "")}
    done = mask(cells.withColumn("unit", F.col("row").cast("long") * 10 + F.col("col")))
    assert [r["line"] for r in csv_lines(done).orderBy("row").collect()] == ["customer id,email", '<ID#0>,"x, <EMAIL#0>"', "1,2,3"]
    (tmp_path / "n.txt").write_bytes(b"ok \xff\n")
    assert file_units(spark, str(tmp_path / "n.txt"), ".txt").first()["text"] == "ok �\n"
    with pytest.raises(ValueError):
        file_units(spark, "x", ".zip")


def test_columns(spark):
    df = spark.createDataFrame([(1, "CUS-1234", 5.0)], "k long, `member id` string, x double")
    assert mask_columns(df, "k", ["member id"]).first()["member id"] == "<PLAN#0>"
